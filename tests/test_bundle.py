"""Versioned bundles: whole versions only, the last published one in force."""
import pytest


def test_versions_and_crash(spark, tmp_dir, monkeypatch):
    from netlens.operators.gate import fit_gate
    from netlens.operators.models import fit_tree, predict, predict_detailed
    from netlens.sources import bundle as B
    path = f"{tmp_dir}/bundle"
    with pytest.raises(FileNotFoundError):
        B.load_bundle(spark, path)
    df = spark.range(400).selectExpr("id", "CAST(id % 37 AS DOUBLE) AS a", "CAST((id * 7) % 29 AS DOUBLE) AS b",
                                     "CASE WHEN id % 37 < 12 THEN 'BenignTraffic' ELSE 'DDoS-UDP_Flood' END AS label")
    gate = fit_gate(df, ["a", "b"], "id", trees=3, psi=32)
    tree = fit_tree(df, ["a", "b"], depth=4)
    first = B.save_bundle(spark, B.Bundle(gate, {"tree": tree}, ["a", "b"], {"f1": 0.9}, {"report": df.limit(3)}), path)
    got = B.load_bundle(spark, path)
    assert (got.version, got.features, got.metrics) == (first, ["a", "b"], {"f1": 0.9})
    assert got.gate.threshold == gate.threshold and got.tables["report"].count() == 3
    same = lambda m: [r["y_pred"] for r in predict(m, df).orderBy("id").collect()]
    assert same(got.models["tree"]) == same(tree)
    # flat scoring rows (M9)
    flat = predict_detailed(got.models["tree"], df.drop("label"))
    assert flat.columns == ["id", "a", "b", "is_anomaly", "attack_type", "label"]
    for r, y in zip(flat.orderBy("id").collect(), same(tree)):
        assert r["label"] == y and r["is_anomaly"] == (y != "BenignTraffic")
        assert r["attack_type"] == ("" if y == "BenignTraffic" else y)

    # a writer that dies after some of its tables leaves the version before it in force
    def dies(*a, **k):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(B, "save_gate", dies)
        with pytest.raises(RuntimeError):
            B.save_bundle(spark, B.Bundle(gate), path)
    assert B.load_bundle(spark, path).version == first
    unpublished = B.write_version(spark, B.Bundle(features=["z"]), path)      # died before the pointer
    assert B.load_bundle(spark, path).version == first
    # two writers: both versions stay, the later entry is in force, old ones can be named
    assert B.publish_version(path, unpublished) == 1
    third = B.save_bundle(spark, B.Bundle(features=["y"]), path)
    assert B.versions(path) == [first, unpublished, third] and B.load_bundle(spark, path).features == ["y"]
    assert B.load_bundle(spark, path, first).metrics == {"f1": 0.9}
