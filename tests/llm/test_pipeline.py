"""The corpus pipeline against a brute-force walk of its stages."""
import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netlens.llm import bpe, mixing, pii, quality, queries, simhash

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, SF).cache()
    verdict = {r["doc_id"]: r["kept"] for r in quality.assess(docs).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, k in verdict.items() if k}
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    one = corpus_pipeline.near_duplicates(spark, kept, SF).cache()
    groups = {}
    for r in kept.collect():
        groups.setdefault(simhash.fingerprint(r["text"]), []).append(r["doc_id"])
    fps = list(groups)
    least = {f: min(groups[f]) for f in fps}
    changed = True
    while changed:                                    # labels flow until nothing changes
        changed = False
        for i, a in enumerate(fps):
            for b in fps[:i]:
                if least[a] != least[b] and (a ^ b).bit_count() <= 3:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    assert {r["doc_id"] for r in one.collect()} == set(least.values())
    clean = corpus_pipeline.personal_data(spark, one, SF).cache()
    text = {r["doc_id"]: r["text"] for r in one.collect()}
    for r in clean.collect():
        assert r["text"] == pii.redact(text[r["doc_id"]], pii.find_spans(text[r["doc_id"]]))
        assert r["n_chars"] == len(r["text"])
        assert [s for s in pii.find_spans(r["text"]) if s["kind"] in ("email", "card", "phone")] == []
    mixed = corpus_pipeline.mix_sources(spark, clean, SF).cache()
    words = lambda d: d.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))).alias("w"))
    target = {r["s"]: r["t"] for r in mixing.mix(clean).groupBy(F.col("row.source").alias("s")).agg(F.first("target").alias("t")).collect()}
    longest = max(len(r["text"].split()) for r in clean.collect())
    for r in words(mixed).collect():
        assert -0.5 <= r["w"] - target[r["source"]] < longest
    assert {r["text"] for r in mixed.collect()} <= {r["text"] for r in clean.collect()}     # whole texts
    ids = corpus_pipeline.tokens(spark, mixed, SF).collect()
    model = bpe.load(queries.vocabulary())
    want = sorted(hashlib.sha256(r["text"].encode()).hexdigest() for r in mixed.collect())
    assert sorted(r["decoded_sha256"] for r in ids) == want
    assert all(hashlib.sha256(model.decode(r["ids"]).encode()).hexdigest() == r["decoded_sha256"] for r in ids[:50])


@pytest.mark.parametrize("rows", [
    [], [(None, None, None, None, None)] * 2,
    [(1, "", None, None, 0), (1, None, "en", "s", 1), (2, "a b c d e f g h i j k " * 3000, "en", None, 1),
     (None, "one two three four five six seven eight nine ten eleven", "en", "s", 5),
     (None, "one two three four five six seven eight nine ten eleven", "en", "s", 5)] +
    [(i, f"q{i} w{i} e{i} r{i} t{i} z{i} u{i} mail{i}@x.org i{i} o{i} p{i} a{i}", "en", "s", 3) for i in range(3, 20)]])
def test_odd_tables(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "doc_id long, text string, lang string, source string, n_chars long, ids string, _gone int")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if len(rows) > 2:
        texts = [bpe.load(queries.vocabulary()).decode(r["ids"]) for r in out]
        assert texts and all("@" not in t for t in texts)
    else:
        assert out == []


@pytest.mark.parametrize("limit", ["24k", "-1"])
def test_near_duplicates_leave_texts_where_they_lie(spark, tmp_path, limit):
    # 17,000 texts twice, in one file: row numbers of two bitmaps; 17,000 row numbers
    # are over the broadcast limit of 24 KB, their bits are under it
    spark.range(0, 34_000, 1, 1).selectExpr(
        "id AS doc_id", "concat(md5(cast(id % 17000 AS string)), ' ', sha1(cast(id % 17000 AS string))) AS text",
        "'en' AS lang", "'s' AS source", "73L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        one = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
        plan = one._jdf.queryExecution().executedPlan().toString()
        kept = sorted(r["doc_id"] for r in one.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert kept == list(range(17_000))
    assert ("hashpartitioning" in plan) == (limit == "-1")


def test_tokens_hold_one_python_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "some words"), (1, "some words"), (None, None), (2, "")], "doc_id long, text string")
    out = corpus_pipeline.tokens(spark, docs, SF)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(r["decoded_sha256"] for r in out.collect()) == sorted(map(digest, ["some words", "some words", "", ""]))
