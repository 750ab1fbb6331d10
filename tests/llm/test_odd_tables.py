"""Empty tables, clashing column names and very long texts for the operators without SQL."""
from pyspark.sql import functions as F

from netlens.llm import bpe, covertree, langid, queries, simhash

DOCS = "doc_id long, text string, lang string"


def test_language_of_an_empty_table(spark):
    model = langid.train(spark.createDataFrame([(1, "alpha beta gamma", "en"), (2, "eins zwei drei", "de")], DOCS))
    assert langid.predict(spark.createDataFrame([], DOCS), model).collect() == []


def test_bpe_empty_table_and_clashing_names(spark):
    path = queries.vocabulary()
    assert bpe.digests(bpe.decode(bpe.encode(spark.createDataFrame([], DOCS), path), path)).collect() == []
    docs = spark.createDataFrame([(1, "one two", "en"), (2, None, None)], DOCS)
    odd = docs.withColumns({"ids": F.lit("x"), "key": F.lit(1), "n_tokens": F.lit("y")})

    def run(df):
        return sorted(map(tuple, bpe.digests(bpe.decode(bpe.encode(df, path), path)).select(
            "doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    assert run(odd) == run(docs)


def test_vectors_with_clashing_names(spark):
    rows = [(i, [1.0 + 0.001 * i, 0.5] + [0.1] * 62) for i in range(4)] + [(9, None), (10, [-1.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    odd = df.withColumns({"v": F.lit("x"), "node": F.lit(1), "mult": F.lit(2.0)})
    want = sorted(map(tuple, covertree.cluster(df).select("vec_id", "n_links", "component_id").collect()))
    assert sorted(map(tuple, covertree.cluster(odd).select("vec_id", "n_links", "component_id").collect())) == want
    assert want[0] == (0, 3, 0) and want[-1] == (10, 0, 10)


def test_simhash_of_very_long_texts(spark):
    text = " ".join(f"w{i * 7919 % 10007}" for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short and plain")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.cluster(df).collect()}
    assert got[1]["component_id"] == got[2]["component_id"] == 1 and got[3]["component_id"] == 3
    assert all(got[i]["fingerprint"] == f"{simhash.fingerprint(t) & (1 << 64) - 1:016x}" for i, t in ((1, text), (2, text + " end")))
