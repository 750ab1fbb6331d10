"""Feature statistics: near-constant and correlated pruning, scaler, class
weights (A29-A31, A33, A37, P12, SA4).

Statistics over all feature columns are single wide aggregations (one pass,
partial aggregation per partition); the results are one row per feature,
so the small per-feature tables may be read on the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.functions.columns import signed_log
from netlens.operators.sampling import hash_unit
from netlens.schema import CORR_THRESH, NEAR_CONST_THRESH, RANDOM_SEED


def _long(row_df: DataFrame, cols: list[str], stats: list[str]) -> DataFrame:
    """One-row wide stats (``<stat>__<col>``) -> one row per feature."""
    s = ", ".join(f"'{c}', " + ", ".join(f"`{st}__{c}`" for st in stats) for c in cols)
    return row_df.selectExpr(f"stack({len(cols)}, {s}) as (feature, {', '.join(stats)})")


def near_constant(df: DataFrame, cols: list[str], eps: float = NEAR_CONST_THRESH) -> DataFrame:
    """Sample variance per feature and whether it is kept (var > eps)."""
    wide = df.agg(*[F.var_samp(c).alias(f"var__{c}") for c in cols])
    return _long(wide, cols, ["var"]).withColumn("keep", F.coalesce(F.col("var") > eps,
                                                                    F.lit(False)))


def correlation_matrix(df: DataFrame, cols: list[str]) -> list[list[float]]:
    """Pearson matrix over ``cols`` from one distributed Gramian aggregation.

    The k x k result is bounded by the number of features, not rows.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    v = VectorAssembler(inputCols=cols, outputCol="_v", handleInvalid="keep").transform(
        df.select(*cols))
    m = Correlation.corr(v, "_v", "pearson").head()[0]
    return m.toArray().tolist()


def correlated(df: DataFrame, cols: list[str], limit: float = CORR_THRESH,
               sample_frac: float | None = None, key: str | None = None,
               seed: int = RANDOM_SEED) -> DataFrame:
    """Columns dropped for |pearson| > limit with ANY earlier column (A30, SA4).

    All rows count; ``sample_frac`` (with ``key``) asks for a hash sample of
    that share of the rows, whatever their number.  Returns (feature, dropped).
    """
    from netlens.session import cut_lineage
    if sample_frac is not None:
        df = df.filter(hash_unit(key, seed) < sample_frac)
    # the correlation makes several passes: read its columns once
    m = correlation_matrix(cut_lineage(df.select(*cols)), cols)
    dropped = []
    for j, c in enumerate(cols):
        if any(abs(m[i][j]) > limit for i in range(j) if m[i][j] == m[i][j]):
            dropped.append(c)
    spark = df.sparkSession
    return spark.createDataFrame([(c, c in dropped) for c in cols], "feature string, dropped boolean")


def scale_stats(df: DataFrame, cols: list[str], log: bool = True) -> DataFrame:
    """Mean and population std per feature, zero std -> 1 (A31), after the
    signed log (P12) when ``log``.  (Spark ML's StandardScaler uses the sample
    std, so it is not used here.)"""
    x = {c: (signed_log(c) if log else F.col(c).cast("double")) for c in cols}
    wide = df.agg(*[F.avg(x[c]).alias(f"mean__{c}") for c in cols],
                  *[F.stddev_pop(x[c]).alias(f"std__{c}") for c in cols])
    out = _long(wide, cols, ["mean", "std"])
    # a (numerically) zero std counts as 1, like a constant column
    return out.withColumn("std", F.when(F.col("std") < 1e-12, F.lit(1.0)).otherwise(F.col("std")))


def apply_scale(df: DataFrame, stats: DataFrame, log: bool = True,
                keep: list[str] | None = None) -> DataFrame:
    """(signed_log(x) - mean) / std with the per-feature stats (one row per feature)."""
    st = {r["feature"]: (r["mean"], r["std"]) for r in stats.collect()}
    cols = [F.col(c) for c in (keep or []) if c in df.columns]
    for c, (m, s) in st.items():
        x = signed_log(c) if log else F.col(c).cast("double")
        cols.append(((x - F.lit(m)) / F.lit(s)).alias(c))
    return df.select(*cols)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced class weights n / (k * n_c)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    from pyspark.sql import Window
    w = Window.partitionBy()          # one row per class: a small window
    return c.select(label, "n_c", (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w)
                                                            * F.col("n_c"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str = "label", col: str = "weight") -> DataFrame:
    """Attach the balanced weight to every row (``weightCol`` for Spark ML)."""
    from netlens.operators.joins import join_small
    return join_small(df, class_weights(df, label).select(label, F.col("weight").alias(col)), label)


def deauth_label(frames: DataFrame, by: str = "file", is_deauth: str = "is_deauth",
                 threshold: int = 1000) -> DataFrame:
    """Deauthentication frames per capture and the label they imply."""
    return (frames.groupBy(by)
                  .agg(F.count(F.lit(1)).alias("frames"),
                       F.sum(F.col(is_deauth).cast("long")).alias("deauth"))
                  .withColumn("label", F.when(F.col("deauth") >= threshold, "attack")
                              .otherwise("benign")))
