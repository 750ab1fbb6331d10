"""Isolation forest: path-length helper and scoring behaviour."""
import math

import pytest
from pyspark.sql import functions as F


def test_c_factor():
    from netlens.operators.gate import c_factor
    assert c_factor(1) == 0 and c_factor(2) == 1
    assert c_factor(256) == pytest.approx(2 * (math.log(255) + 0.5772156649015329) - 2 * 255 / 256)


def test_outliers_score_higher(spark):
    from netlens.operators.gate import fit_gate, score_gate
    rows = [(i, float(i % 17), float((i * 7) % 13)) for i in range(2000)]
    rows += [(10_000 + i, 500.0 + i, -400.0) for i in range(5)]          # far away
    df = spark.createDataFrame(rows, "id long, a double, b double")
    g = fit_gate(df.filter("id < 10000"), ["a", "b"], "id", trees=50, contamination=0.05)
    s = score_gate(df, g)
    out = s.filter("id >= 10000").agg(F.min("anomaly_score"), F.min(F.col("is_anomaly").cast("int"))).first()
    inl = s.filter("id < 10000").agg(F.avg(F.col("is_anomaly").cast("double"))).first()[0]
    assert out[1] == 1 and out[0] > g.threshold
    assert inl == pytest.approx(0.05, abs=0.03)                      # contamination share
    assert g.nodes["tree"].nunique() == 50 and g.nodes.groupby("tree")["size"].first().max() <= 256


def test_one_sampling_scheme_at_any_size(spark):
    """A row's draw for a tree depends on its key and the tree only: the trees of a
    small table hold its rows, those of a large one a full sample each."""
    from netlens.operators.gate import fit_gate, score_gate
    df = spark.range(30_000).selectExpr("id", "CAST(id % 101 AS DOUBLE) AS a",
                                        "CAST((id * 7) % 89 AS DOUBLE) AS b")
    g = fit_gate(df, ["a", "b"], "id", trees=10, psi=256)
    sizes = g.nodes[g.nodes["node"] == 0]["size"]
    assert len(sizes) == 10 and sizes.min() == 256         # every tree got a full sample
    flagged = score_gate(df, g).agg(F.avg(F.col("is_anomaly").cast("double"))).first()[0]
    assert flagged == pytest.approx(0.05, abs=0.03)
    small = fit_gate(df.filter("id < 200"), ["a", "b"], "id", trees=10, psi=256)
    assert (small.nodes[small.nodes["node"] == 0]["size"] == 200).all()


def test_gate_round_trip_and_recalibration(spark, tmp_dir):
    from netlens.operators.gate import fit_gate, load_gate, recalibrate, save_gate, score_gate
    df = spark.range(600).selectExpr("id", "CAST(id % 37 AS DOUBLE) AS a", "CAST((id * 7) % 29 AS DOUBLE) AS b")
    g = fit_gate(df, ["a", "b"], "id", trees=7, psi=64, contamination=0.2)
    save_gate(g, spark, f"{tmp_dir}/gate")
    back = load_gate(spark, f"{tmp_dir}/gate")
    assert (back.trees, back.contamination, back.psi, back.features) == (7, 0.2, 64, ["a", "b"])
    scores = lambda gate: [r["anomaly_score"] for r in score_gate(df, gate).orderBy("id").collect()]
    assert scores(back) == scores(g) and back.threshold == g.threshold
    again = recalibrate(back, df.filter("id < 300"), "id")
    assert again.trees == 7 and again.contamination == 0.2 and again.nodes["tree"].nunique() == 7


def test_too_deep_a_tree_is_refused(spark):
    from netlens.operators.models import fit_tree
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, label string")
    with pytest.raises(ValueError, match="30"):
        fit_tree(df, ["x"], depth=35)
