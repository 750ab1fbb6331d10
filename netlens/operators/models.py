"""Classifiers and model evaluations on Spark ML.

Trees and forests are Spark ML estimators (distributed, binned splits);
Spark caps tree depth at 30: that is the default, and more is refused.
Every evaluation goes through the long confusion table of
:mod:`netlens.operators.evaluate`.
"""
from __future__ import annotations

import time

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.operators import evaluate as EV
from netlens.operators import sampling as SA
from netlens.operators.gate import Gate, fit_gate, score_gate
from netlens.operators.prune import with_class_weight
from netlens.schema import BENIGN_LABEL, RANDOM_SEED
from netlens.session import cut_lineage

MAX_SPARK_DEPTH = 30


def _depth(depth: int) -> int:
    if depth > MAX_SPARK_DEPTH:
        raise ValueError(f"Spark trees have at most {MAX_SPARK_DEPTH} levels, not {depth}")
    return depth


def _pipeline(features: list[str], label: str, clf) -> Pipeline:
    idx = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc",
                        handleInvalid="keep")
    vec = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    return Pipeline(stages=[idx, vec, clf])


def fit_tree(df: DataFrame, features: list[str], label: str = "label", depth: int = 30,
             leaf: int = 5, balanced: bool = False, max_bins: int = 64,
             seed: int = RANDOM_SEED) -> PipelineModel:
    """Decision tree (M1, M2, M4): alphabetical label index, optional balanced weights.

    The training table is checkpointed once (shared checkpoint folder): the
    estimator makes several passes and none of them recomputes the lineage.
    """
    data = with_class_weight(df, label, "_w") if balanced else df
    data = cut_lineage(data.select(label, *features, *(["_w"] if balanced else [])))
    clf = DecisionTreeClassifier(featuresCol="_x", labelCol="_y", predictionCol="_p",
                                 maxDepth=_depth(depth), minInstancesPerNode=leaf,
                                 maxBins=max_bins, seed=seed,
                                 **({"weightCol": "_w"} if balanced else {}))
    return _pipeline(features, label, clf).fit(data)


def fit_forest(df: DataFrame, features: list[str], label: str = "label", trees: int = 50,
               depth: int = 20, leaf: int = 1, seed: int = RANDOM_SEED) -> PipelineModel:
    """Random forest for the model bake-off (M5)."""
    df = cut_lineage(df.select(label, *features))
    clf = RandomForestClassifier(featuresCol="_x", labelCol="_y", predictionCol="_p",
                                 numTrees=trees, maxDepth=_depth(depth),
                                 minInstancesPerNode=leaf, seed=seed)
    return _pipeline(features, label, clf).fit(df)


def predict(model: PipelineModel, df: DataFrame, out: str = "y_pred") -> DataFrame:
    """Flat scoring (M9): predicted class name (J14 index -> name)."""
    labels = model.stages[0].labels
    res = model.transform(df)
    back = IndexToString(inputCol="_p", outputCol=out, labels=list(labels) + ["__unseen__"])
    return back.transform(res).drop("_y", "_x", "_p", "rawPrediction", "probability")


def predict_detailed(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Flat scoring rows (M9): ``is_anomaly, attack_type, label`` beside the columns of
    ``df``, as the gate's two stages give them; the attack type of benign traffic is empty."""
    out = predict(model, df, "_flat")
    anomaly = F.col("_flat") != BENIGN_LABEL
    return out.select(*df.columns, anomaly.alias("is_anomaly"),
                      F.when(anomaly, F.col("_flat")).otherwise("").alias("attack_type"),
                      F.col("_flat").alias("label"))


def timed(fit, *args, **kw):
    """(fitted model, wall seconds of the fit), for the bake-off's table (M5)."""
    start = time.perf_counter()
    model = fit(*args, **kw)
    return model, time.perf_counter() - start


def label_index(df: DataFrame, label: str = "label") -> DataFrame:
    """Class -> index as the classifiers see it: alphabetical, from 0."""
    classes = df.select(label).distinct()
    idx = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip")
    return idx.fit(classes).transform(classes).select(label, F.col("_y").cast("long").alias("index"))


def session_supports(df: DataFrame, label: str = "label", source: str = "source", key: str = "id",
                     pick: str = "last") -> DataFrame:
    """Rows per class that :func:`leave_session_out` tests on (M10): within, held out."""
    m = SA.stratified_split(SA.mark_held_out(df, label, source, pick), label, 0.8, key)
    return m.groupBy(label).agg(F.count_if(~F.col("is_train")).alias("within_rows"),
                                F.count_if("is_held_out").alias("held_out_rows"))


def importance(model: PipelineModel, features: list[str], top: int | None = 15) -> DataFrame:
    """Feature importances, descending."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    df = s.createDataFrame(list(zip(features, imp)), "feature string, importance double")
    return EV.rank(df, "importance", n=top, tie="feature")


def evaluate(model: PipelineModel, test: DataFrame, label: str = "label") -> DataFrame:
    """A17 metrics of a fitted model on a test table."""
    p = predict(model, test)
    return EV.scalar_metrics(EV.confusion(p, label, "y_pred"))


def search_tree(train: DataFrame, features: list[str], label: str = "label", key: str = "id",
                configs: list[dict] | None = None, validation: DataFrame | None = None):
    """Fit every config, choose the best macro-F1, first on ties.

    The choice is made on ``validation``, by default a stratified fifth of the
    training rows that the compared models do not see; test rows have no part in
    it.  Returns the metrics per config and the chosen config fitted on all
    training rows.
    """
    configs = configs or [dict(depth=30, leaf=2), dict(depth=30, leaf=5),
                          dict(depth=30, leaf=2, balanced=True)]
    fitted = train
    if validation is None:
        split = cut_lineage(SA.stratified_split(train, label, 0.8, key))
        fitted, validation = split.filter("is_train"), split.filter(~F.col("is_train"))
    rows = None
    for i, cfg in enumerate(configs):
        r = evaluate(fit_tree(fitted, features, label, **cfg), validation, label).withColumn("config", F.lit(i))
        rows = r if rows is None else rows.unionByName(r)
    rows = cut_lineage(rows)                         # one row per config
    best = EV.best_by(rows, "f1_macro", "config").first()["config"]
    return rows, fit_tree(train, features, label, **configs[best])


def score_two_stage(df: DataFrame, gate: Gate, model: PipelineModel) -> DataFrame:
    """Gate first, class only for anomalous rows (M8); benign rows keep BenignTraffic."""
    scored = predict(model, score_gate(df, gate))
    return scored.withColumn("label_pred", F.when(F.col("is_anomaly"), F.col("y_pred"))
                             .otherwise(F.lit(BENIGN_LABEL)))


def leave_session_out(df: DataFrame, features: list[str], label: str = "label",
                      source: str = "source", key: str = "id", pick: str = "last"):
    """Within- vs cross-session recall (M10): held-out session per class.

    Two models: one on a stratified 80% of all rows, recall on the other 20%
    (within), and one on every row outside the held-out sessions, recall on
    those (cross) (A19); gap per class (J9) and summary (A20)."""
    m = cut_lineage(SA.stratified_split(SA.mark_held_out(df, label, source, pick), label, 0.8, key))
    inner = fit_tree(m.filter("is_train"), features, label)
    within = EV.recall_by_class(predict(inner, m.filter(~F.col("is_train"))), label, "y_pred")
    outer = fit_tree(m.filter(~F.col("is_held_out")), features, label)
    cross = EV.recall_by_class(predict(outer, m.filter("is_held_out")), label, "y_pred")
    gap = EV.session_gap(within, cross)
    return gap, EV.gap_summary(gap)


def gate_scenarios(df: DataFrame, features: list[str], key: str, is_benign: str = "is_benign",
                   source: str = "source", trees: int = 200):
    """Cross-network and on-site gate tests.

    cross: fit on the benign rows of the first source, test everything else;
    onsite: 80/20 split inside every benign source (SA6), fit on the 80%.
    """
    first = df.agg(F.min(source)).first()[0]
    cross_gate = fit_gate(df.filter(F.col(is_benign) & (F.col(source) == first)), features, key,
                          trees=trees)
    cross = score_gate(df.filter(F.col(source) != first), cross_gate) \
        .withColumn("scenario", F.lit("cross_network"))
    split = SA.stratified_split(df.filter(F.col(is_benign)), source, 0.8, key)
    on_gate = fit_gate(split.filter("is_train").drop("is_train"), features, key, trees=trees)
    test = split.filter(~F.col("is_train")).drop("is_train").unionByName(
        df.filter(~F.col(is_benign)).select(*split.drop("is_train").columns))
    onsite = score_gate(test, on_gate).withColumn("scenario", F.lit("on_site"))
    both = cross.select("scenario", is_benign, F.col("is_anomaly").alias("flagged")).unionByName(
        onsite.select("scenario", is_benign, F.col("is_anomaly").alias("flagged")))
    return EV.gate_rates(both, by="scenario", is_benign=is_benign, flagged="flagged")


def benign_holdout(df: DataFrame, features: list[str], label: str = "label",
                   source: str = "source", held_out: str | None = None):
    """Binary model without one benign session, tested on it."""
    b = df.withColumn("_bin", F.when(F.col(label) == BENIGN_LABEL, "Benign").otherwise("Attack"))
    if held_out is None:
        held_out = b.filter(F.col("_bin") == "Benign").agg(F.max(source)).first()[0]
    model = fit_tree(b.filter(F.col(source) != held_out), features, "_bin")
    p = predict(model, b.filter(F.col(source) == held_out))
    return EV.scalar_metrics(EV.confusion(p, "_bin", "y_pred"))


def augment(train: DataFrame, extra: DataFrame, label: str = "label", key: str = "id",
            cap: int = 6000, reps: int = 3, test: DataFrame | None = None) -> DataFrame:
    """Extra rows capped per class (W9) and repeated (U2), train side only.

    With ``test``, extra rows whose key occurs there are refused."""
    if test is not None and not extra.join(test.select(key), key, "left_semi").isEmpty():
        raise ValueError("extra rows occur in the test set")
    e = SA.sample_n(extra, cap, key, by=[label])
    e = SA.replicate(e, reps).drop("rep")
    return train.unionByName(e.select(*train.columns))


def evaluate_end_to_end(df: DataFrame, gate: Gate, model: PipelineModel, label: str = "label",
                      key: str = "id", per_class: int = 100) -> DataFrame:
    """End-to-end rates on ``per_class`` unseen rows per class."""
    test = SA.sample_n(df, per_class, key, by=[label])
    s = score_two_stage(test, gate, model)
    return EV.end_to_end_rates(s, label, "label_pred")
