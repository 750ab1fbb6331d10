"""Quality reports from predictions.

Everything starts from the long confusion table ``(y_true, y_pred, n)``:
one aggregation over the predictions, after which every report works on a
table with at most classes^2 rows.  Zero divisions give 0 (sklearn's
``zero_division=0``); F1 is ``2 tp / (2 tp + fp + fn)``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.session import cut_lineage


def confusion(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Long confusion matrix (A15): y_true, y_pred, n."""
    return df.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")) \
        .agg(F.count(F.lit(1)).alias("n"))


def confusion_wide(conf: DataFrame) -> DataFrame:
    """Pivoted confusion matrix for output only (one column per predicted class)."""
    return conf.groupBy("y_true").pivot("y_pred").agg(F.sum("n")).fillna(0)


def _zdiv(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_stats(conf: DataFrame) -> DataFrame:
    """Per class over the union of true and predicted labels: tp, support, predicted.

    Every confusion row counts for its true and for its predicted class: one
    pass over the confusion table and one aggregation.
    """
    zero = F.lit(0).cast("long")
    tp = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("y_true").alias("class"), tp.alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("y_pred").alias("class"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")))
    return (conf.select(F.explode(sides).alias("_s")).select("_s.*").groupBy("class")
                .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")]))


def _per_class_tp(conf: DataFrame) -> DataFrame:
    s = class_stats(conf)
    return s.select(
        F.col("class").cast("string").alias("class"),
        _zdiv(F.col("tp"), F.col("predicted")).alias("precision"),
        _zdiv(F.col("tp"), F.col("support")).alias("recall"),
        _zdiv(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        F.col("support"), F.col("tp"))


def per_class(conf: DataFrame) -> DataFrame:
    """Per-class precision / recall / F1 / support (A16), class rows only."""
    return _per_class_tp(conf).drop("tp")


def classification_report(conf: DataFrame) -> DataFrame:
    """A16 with the summary rows: ``accuracy``, ``macro avg``, ``weighted avg``.

    The accuracy row carries accuracy in precision/recall/f1 and the total
    support.  Every summary comes from one aggregation over the per-class
    table (accuracy = sum of true positives / total support).
    """
    pc = cut_lineage(_per_class_tp(conf))            # one row per class, used four times
    tot = pc.agg(
        F.sum("support").alias("total"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        _zdiv(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
        _zdiv(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
        _zdiv(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"),
        _zdiv(F.sum("tp"), F.sum("support")).alias("acc"))
    rows = [("macro avg", "mp", "mr", "mf"), ("weighted avg", "wp", "wr", "wf"),
            ("accuracy", "acc", "acc", "acc")]
    out = pc.drop("tp")
    for name, p_, r_, f_ in rows:
        out = out.unionByName(tot.select(F.lit(name).alias("class"), F.col(p_).alias("precision"),
                                         F.col(r_).alias("recall"), F.col(f_).alias("f1"),
                                         F.col("total").alias("support")))
    return out


def scalar_metrics(conf: DataFrame) -> DataFrame:
    """accuracy, balanced accuracy, macro/weighted F1, macro precision/recall.

    Macro averages run over the union of true and predicted labels,
    balanced accuracy over the true labels only.  One aggregation over the
    per-class table.
    """
    pc = _per_class_tp(conf)
    return pc.agg(
        _zdiv(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("f1_macro"),
        _zdiv(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"))


def reweighted(conf: DataFrame, priors: DataFrame, label: str = "label",
               count: str = "n") -> tuple[DataFrame, DataFrame]:
    """Metrics at other class proportions.

    R[k,c] = C[k,c] / max(N_k, 1); J = R * pi_k with pi = priors normalised
    over the confusion's classes.  Recall is R[k,k]; precision J[c,c] /
    sum_k J[k,c]; accuracy = sum_k J[k,k]; macro-F1 averages over every
    class; weighted-F1 weighs by pi.  Returns (per-class table, one-row
    summary).
    """
    conf = cut_lineage(conf)                         # at most classes^2 rows, used five times
    classes = conf.select(F.col("y_true").alias("class")).union(
        conf.select(F.col("y_pred").alias("class"))).distinct()
    pri = priors.select(F.col(label).alias("class"), F.col(count).cast("double").alias("_cnt"))
    pri = classes.join(pri, "class", "left").fillna(0.0, ["_cnt"])
    pri = pri.withColumn("pi", F.col("_cnt") / F.sum("_cnt").over(Window.partitionBy()))
    nk = conf.groupBy(F.col("y_true").alias("class")).agg(F.sum("n").alias("_nk"))
    r = (conf.join(nk.withColumnRenamed("class", "y_true"), "y_true")
             .join(pri.select(F.col("class").alias("y_true"), "pi"), "y_true")
             .withColumn("r", F.col("n") / F.greatest(F.col("_nk"), F.lit(1)))
             .withColumn("j", F.col("r") * F.col("pi")))
    diag = r.filter(F.col("y_true") == F.col("y_pred")).select(
        F.col("y_true").alias("class"), F.col("r").alias("recall"), F.col("j").alias("jd"))
    col = r.groupBy(F.col("y_pred").alias("class")).agg(F.sum("j").alias("jc"))
    pc = (pri.select("class", "pi").join(diag, "class", "left").join(col, "class", "left")
             .fillna(0.0, ["recall", "jd", "jc"]))
    pc = pc.withColumn("precision", _zdiv(F.col("jd"), F.col("jc")))
    pc = pc.withColumn("f1", _zdiv(2 * F.col("precision") * F.col("recall"),
                                   F.col("precision") + F.col("recall")))
    per = pc.select(F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "pi")
    summary = pc.agg(
        F.sum("jd").alias("accuracy"), F.avg("f1").alias("f1_macro"),
        F.sum(F.col("f1") * F.col("pi")).alias("f1_weighted"),
        F.avg("recall").alias("recall_macro"), F.avg("precision").alias("precision_macro"))
    return per, summary


def recall_by_class(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per-class recall over a subset (A19); classes without rows are absent (NULL)."""
    return df.groupBy(F.col(y_true).alias("class")).agg(
        F.avg((F.col(y_true) == F.col(y_pred)).cast("double")).alias("recall"),
        F.count(F.lit(1)).alias("support"))


def session_gap(within: DataFrame, cross: DataFrame) -> DataFrame:
    """Within- vs cross-session recall per class and their gap."""
    return (within.select("class", F.col("recall").alias("within"))
                  .join(cross.select("class", F.col("recall").alias("cross")), "class")
                  .withColumn("gap", F.col("within") - F.col("cross")))


def gap_summary(gap: DataFrame, good: float = 0.8, bad: float = 0.5) -> DataFrame:
    """Mean within / cross / gap, classes with cross >= good and < bad."""
    return gap.agg(F.avg("within").alias("mean_within"), F.avg("cross").alias("mean_cross"),
                   F.avg("gap").alias("mean_gap"),
                   F.count_if(F.col("cross") >= good).alias("n_cross_good"),
                   F.count_if(F.col("cross") < bad).alias("n_cross_bad"),
                   F.count(F.lit(1)).alias("n_classes"))


def support_vs_f1(counts: DataFrame, report: DataFrame, label: str = "label") -> DataFrame:
    """Class support next to per-class F1, full outer."""
    return (counts.select(F.col(label).cast("string").alias("class"), F.col("n").alias("rows"))
                  .join(report.select("class", "f1"), "class", "full"))


def report_delta(a: DataFrame, b: DataFrame, limit: float = 0.02) -> DataFrame:
    """F1 before (a) and after (b) per class, delta, regression flag."""
    return (a.select("class", F.col("f1").alias("f1_a"))
             .join(b.select("class", F.col("f1").alias("f1_b")), "class")
             .withColumn("delta", F.col("f1_b") - F.col("f1_a"))
             .withColumn("regressed", F.col("delta") < -limit))


def rank(df: DataFrame, metric: str, n: int | None = None, ascending: bool = False,
         tie: str | None = None) -> DataFrame:
    """Order by a metric (T1), optionally top/bottom ``n``."""
    o = F.col(metric).asc() if ascending else F.col(metric).desc()
    cols = [o] + ([F.col(tie).asc()] if tie else [])
    out = df.orderBy(*cols)
    return out.limit(n) if n is not None else out


def best_by(df: DataFrame, metric: str, order: str) -> DataFrame:
    """Best row by ``metric``, the earliest ``order`` on ties."""
    return df.agg(F.max_by(F.struct(*df.columns),
                           F.struct(F.col(metric), -F.col(order))).alias("_b")).select("_b.*")


def gate_rates(df: DataFrame, by: str | None = None, is_benign: str = "is_benign",
               flagged: str = "flagged") -> DataFrame:
    """Benign passed and attack flagged rates."""
    g = df.groupBy(by) if by else df.groupBy()
    return g.agg(
        F.avg(F.when(F.col(is_benign), (~F.col(flagged)).cast("double"))).alias("benign_pass"),
        F.avg(F.when(~F.col(is_benign), F.col(flagged).cast("double"))).alias("attack_flagged"),
        F.count(F.lit(1)).alias("rows"))


def end_to_end_rates(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                   benign: str = "BenignTraffic") -> DataFrame:
    """End-to-end rates (A36): overall accuracy, benign pass, attack caught, exact class."""
    t, p = F.col(y_true), F.col(y_pred)
    return df.agg(
        F.avg((t == p).cast("double")).alias("accuracy"),
        F.avg(F.when(t == benign, (p == benign).cast("double"))).alias("benign_pass"),
        F.avg(F.when(t != benign, (p != benign).cast("double"))).alias("attack_caught"),
        F.avg(F.when(t != benign, (t == p).cast("double"))).alias("attack_exact"))
