"""Hash-rank quotas against brute force on a skewed fixture (SA2, SA3, W9, W10)."""
import hashlib

import pytest


def draw(key, seed=42):
    return int(hashlib.md5(f"{key}|{seed}".encode()).hexdigest()[:15], 16)


@pytest.fixture(scope="module")
def skewed(spark):
    # group "hot" holds a third of the rows
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 7}") for i in range(3000)]
    return spark.createDataFrame(rows, "id long, label string"), rows


def brute(rows, quota):
    by = {}
    for i, g in rows:
        by.setdefault(g, []).append(i)
    keep = set()
    for g, ids in by.items():
        q = quota(g, len(ids))
        keep |= set(sorted(ids, key=lambda i: (draw(i), i))[:q])
    return keep


def test_quota_per_group(skewed):
    from netlens.operators.sampling import sample_n
    df, rows = skewed
    got = {r["id"] for r in sample_n(df, 100, "id", by=["label"]).collect()}
    assert got == brute(rows, lambda g, n: 100)


def test_global_sample_n(skewed):
    from netlens.operators.sampling import sample_n
    df, rows = skewed
    got = {r["id"] for r in sample_n(df, 250, "id").collect()}
    assert got == set(sorted((i for i, _ in rows), key=lambda i: (draw(i), i))[:250])


def test_fraction_and_split(skewed):
    from netlens.operators.sampling import sample_frac, stratified_split
    df, rows = skewed
    got = {r["id"] for r in sample_frac(df, 0.25, "id", ["label"]).collect()}
    assert got == brute(rows, lambda g, n: int(n * 0.25 + 0.5))
    split = {r["id"]: r["is_train"] for r in stratified_split(df, "label", 0.8, "id").collect()}
    assert {i for i, t in split.items() if t} == brute(rows, lambda g, n: int(n * 0.8 + 0.5))
    assert len(split) == len(rows)


def test_hash_unit_matches_python(spark):
    from netlens.operators.sampling import hash_unit
    df = spark.range(5).withColumn("u", hash_unit("id"))
    for r in df.collect():
        assert r["u"] == pytest.approx(draw(r["id"]) / 2 ** 60, rel=1e-15)


def test_exclude_seen_null_safe(spark):
    from netlens.operators.sampling import exclude_seen
    a = spark.createDataFrame([(1, None), (2, 1.0), (3, 2.0)], "id long, x double")
    s = spark.createDataFrame([(9, None), (8, 2.0)], "id long, x double")
    assert sorted(r["id"] for r in exclude_seen(a, s, ["x"]).collect()) == [2]


def test_ungrouped_quota(spark):
    from netlens.operators.sampling import hash_draw, rank_below
    df = spark.range(500).select("id", hash_draw("id", 3).alias("h"))
    want = sorted(df.collect(), key=lambda r: (r["h"], r["id"]))
    for n in (0, 1, 137, 500, 900):
        got = rank_below(df, [], n, "id", 3, flag="made").filter("made").collect()
        assert {r["id"] for r in got} == {r["id"] for r in want[:n]}
    assert rank_below(df.filter("id < 0"), [], 5, "id").count() == 0


def test_augment_refuses_test_rows(spark):
    import pytest
    from netlens.operators.models import augment
    df = spark.range(20).selectExpr("CAST(id AS STRING) AS id", "'a' AS label")
    with pytest.raises(ValueError, match="test set"):
        augment(df.filter("id < 10"), df.filter("id > 12"), test=df.filter("id > 15"))
    assert augment(df.filter("id < 10"), df.filter("id > 15"), reps=2, test=df.filter("id = 12")).count() == 18


def test_rank_below_property(spark):
    """Random group sizes, skews and quotas: the histogram method equals brute force."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from netlens.operators.sampling import rank_below

    @settings(max_examples=6, deadline=None)
    @given(sizes=st.lists(st.integers(0, 400), min_size=1, max_size=4),
           quotas=st.lists(st.integers(0, 450), min_size=4, max_size=4),
           seed=st.integers(0, 10_000))
    def check(sizes, quotas, seed):
        rows, i = [], 0
        for g, n in enumerate(sizes):
            for _ in range(n):
                rows.append((i, f"g{g}"))
                i += 1
        if not rows:
            return
        df = spark.createDataFrame(rows, "id long, label string")
        q = spark.createDataFrame([(f"g{g}", quotas[g]) for g in range(len(sizes))],
                                  "label string, quota long")
        got = {r["id"] for r in rank_below(df, ["label"], q, "id", seed).collect()}
        want = set()
        for g in range(len(sizes)):
            ids = [r for r, lab in rows if lab == f"g{g}"]
            want |= set(sorted(ids, key=lambda k: (draw(k, seed), k))[:quotas[g]])
        assert got == want

    check()


def test_null_groups_and_keys_keep_their_rows(spark):
    from netlens.operators.sampling import hash_draw, sample_frac, sample_n, stratified_split
    rows = [(i, "a" if i < 10 else None if i < 20 else "b", i % 3 or None) for i in range(30)] + [(None, "a", 1), (None, None, None)]
    df = spark.createDataFrame(rows, "id long, label string, site int").repartition(5)
    split = stratified_split(df, "label", 0.7, "id").collect()
    assert len(split) == 32
    by = {}
    for r in split:
        by.setdefault(r["label"], []).append(r["is_train"])
    assert {k: (sum(v), len(v)) for k, v in by.items()} == {"a": (8, 11), None: (8, 11), "b": (7, 10)}
    draw = {r["id"]: r["d"] for r in df.select("id", hash_draw("id").alias("d")).collect()}
    picked = sample_n(df, 4, "id", by=["label"]).collect()
    want = set()
    for label in ("a", None, "b"):
        own = sorted((r[0] is not None, draw[r[0]] or 0, r[0] or 0) for r in rows if r[1] == label)
        want |= {(label, k if has else None) for has, _, k in own[:4]}
    assert {(r["label"], r["id"]) for r in picked} == want and len(picked) == 12
    assert sample_frac(df, 1.0, "id", by=["label", "site"]).count() == 32
    assert stratified_split(df, "label", 0.5, "id", by=["site"]).count() == 32
    assert {r["id"] for r in sample_n(df.where("label = 'a'"), 1, "id").collect()} == {None}
    assert sample_n(df.where("id is not null"), 7, "id").count() == 7


def test_exclude_seen_types_and_null_places(spark):
    from netlens.operators.sampling import exclude_seen
    a = spark.createDataFrame([(1, 1, None, 0.0), (2, None, 1, 0.0), (3, 5, 5, -0.0), (4, 5, 6, float("nan")), (5, None, None, None)],
                              "id int, x int, y int, z double")
    # other types, repeats, values that do not fit an int, nulls in other places
    s = spark.createDataFrame([(None, 1.0, 0.0), (5.0, 5.0, 0.0), (5.0, 5.0, 0.0), (1e30, 6.0, 1.0), (5.5, 6.0, float("nan"))],
                              "x double, y double, z double")
    assert sorted(r["id"] for r in exclude_seen(a, s, ["x", "y", "z"]).collect()) == [1, 4, 5]
    assert exclude_seen(a, s, ["x", "y", "z"]).columns == a.columns
    assert exclude_seen(a, s.limit(0), ["x", "y", "z"]).count() == 5


def test_exclude_seen_joins_on_hashes(spark):
    from netlens.operators.sampling import exclude_seen
    a = spark.createDataFrame([(1, 1, 2)], "id int, x int, y int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = exclude_seen(a, a.select("x", "y"), ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert len(exchanges) == 2 and all(line.count("L,") + line.count("L)") >= 1 and "x#" not in line.split("hashpartitioning")[1]
                                       for line in exchanges)


def test_quota_builds_with_few_jobs(spark):
    """A split writes its group tables once and measures one of them; its joins write none."""
    from netlens.operators import joins, sampling
    calls = []
    cut, small = sampling.cut_lineage, sampling.is_small
    sampling.cut_lineage = lambda df: calls.append("cut") or cut(df)
    sampling.is_small = lambda df, **kw: calls.append("size") or small(df, **kw)
    inner, joins.cut_lineage = joins.cut_lineage, lambda df: calls.append("join") or cut(df)
    try:
        sampling.stratified_split(spark.range(500).selectExpr("id", "id % 3 AS label"), "label", 0.8, "id")
    finally:
        sampling.cut_lineage, sampling.is_small, joins.cut_lineage = cut, small, inner
    assert calls == ["cut", "size", "cut"]
