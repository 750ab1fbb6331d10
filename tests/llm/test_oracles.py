"""The operators that SQL can express, against DuckDB on whole tables; odd rows on small ones."""
import duckdb
import pytest

from netlens.llm import queries
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, queries.QUERIES[name], queries.ORACLE[name], SF)


def odd_documents():
    rows = [(i, f"boiler plate line of the site\n{' '.join(f'w{i}x{k}' for k in range(12))} end", "en", "s1" if i % 3 else "s0", 1)
            for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", None, 0), (102, "a b c d e " * 40, "en", "s2", 1), (103, "one " * 9, "de", "s2", 1),
             (104, "word " * 30_000, "en", "s2", 1), (105, " \t\x0b\x0c\r\n", "en", "s2", 1), (106, "x | y # z <b> $ % & *\nx\nx\n\nx y", "en", "s3", 1),
             (107, "Boiler  plate\tline of the site\nBOILER plate line of the site", "en", "s1", 2),
             (108, "é ü 中 " * 5 + "\n" + "né 😀 " * 3, "fr", "s3", 1), (109, "same text twice over and over it goes here now", "en", "s3", 1),
             (110, "same text twice over and over it goes here now", "en", "s3", 1)]
    return rows


@pytest.mark.parametrize("name", ["op5_quality", "op6_mixing"])
@pytest.mark.parametrize("case", ["odd", "empty"])
def test_odd_rows(spark, tmp_path, name, case):
    rows = odd_documents() if case == "odd" else []
    # columns whose names the operators use themselves
    df = spark.createDataFrame([(*r, "k", 1, "r") for r in rows],
                               "doc_id long, text string, lang string, source string, n_chars long, host string, size int, row string")
    df.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare(spark, con, name, queries.QUERIES[name], queries.ORACLE[name], str(tmp_path))


def test_line_rule_removes_and_rejects(spark, tmp_path):
    from netlens.llm import quality
    df = spark.createDataFrame([r[:4] for r in odd_documents()], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.assess(df).collect()}
    assert got[1]["kept"] and got[1]["words_removed"] == 6
    assert not got[107]["kept"] and got[107]["words_removed"] == 12      # nothing but the boiler plate
    assert not got[104]["kept"] and got[104]["base_failed"]
    clean = {r["doc_id"]: r["text"] for r in quality.apply(df).collect()}
    assert "boiler" not in clean[1] and clean[1].startswith("w1x0") and 107 not in clean


def test_mix_blocks_and_shards(spark):
    from pyspark.sql import functions as F

    from netlens.llm import mixing
    df = spark.createDataFrame([(i, "w " * (i % 17), f"s{i % 5 if i % 2 else 0}") for i in range(500)], "doc_id long, text string, source string")
    mixed = mixing.mix(df)
    pieces = mixed.select("row.source", "size", F.explode("pieces").alias("p")).select("source", "size", "p.*")
    assert pieces.where("shard < 0 or shard >= 16").count() == 0
    for r in mixing.taken(mixed).groupBy("row.source").agg(F.sum("taken").alias("t"), F.first("target").alias("x")).collect():
        assert abs(r["t"] - r["x"]) <= 0.5
    again = mixing.mix(df.repartition(7))
    key = lambda m: sorted((r["row"]["doc_id"], str(r["pieces"])) for r in m.collect())
    assert key(mixed) == key(again)
    dealt = mixing.deal(mixed)
    assert dealt.columns == df.columns
    # whole texts only, each source over its quota by less than a document
    whole = {r["doc_id"]: r for r in df.collect()}
    words = {}
    for r in dealt.collect():
        assert r["text"] == whole[r["doc_id"]]["text"]
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    for r in mixing.taken(mixed).groupBy("row.source").agg(F.sum("taken").alias("t")).collect():
        assert 0 <= words[r["source"]] - r["t"] < 16


def test_mix_writes_no_second_copy_of_the_texts(spark, monkeypatch):
    from netlens.llm import mixing
    df = spark.createDataFrame([(i, "w " * (i % 17), f"s{i % 3}" if i % 5 else None) for i in range(400)] * 2 + [(None, None, None)],
                               "doc_id long, text string, source string")
    written, write = {}, mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda d, name: written.setdefault(name, d) and write(d, name))
    rows = lambda m: sorted((str(r["row"]["doc_id"]), r["size"], str(r["pieces"])) for r in m.collect())
    whole = rows(mixing.mix(df))
    assert written and not [n for n, d in written.items() if "text" in d.schema.simpleString()]
    assert len(whole) == 801 and whole == rows(mixing.mix(df, keep=["doc_id"]))


def test_mix_goes_through_its_tree(spark, monkeypatch):
    from pyspark.sql import functions as F

    from netlens.llm import mixing
    df = spark.createDataFrame([(i, "w " * (1 + i % 17), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    quotas = []
    tree = mixing.split_quotas

    def kept(*args, **kw):
        out = tree(*args, **kw)
        quotas.extend((r["place"], r["shard"], r["q"]) for r in out.collect())
        return out

    result = lambda: sorted((r["row"]["doc_id"], r["taken"], r["shard_words"])
                            for r in mixing.taken(mixing.mix(df)).collect())
    monkeypatch.setattr(mixing, "split_quotas", kept)
    rows = result()
    # blocks are one word here, so a shard's words are the blocks that the tree gave it
    drawn = {}
    for _, _, given in rows:
        for s, w in (x.split(":") for x in given.split(",") if x):
            drawn[int(s)] = drawn.get(int(s), 0) + int(w)
    assert drawn == {s: sum(q for _, t, q in quotas if t == s) for s in range(16)}
    assert all(t == sum(int(x.split(":")[1]) for x in given.split(",") if x) for _, t, given in rows)
    # a tree that deals nothing to half its shards takes half as much
    monkeypatch.setattr(mixing, "split_quotas", lambda *a, **kw: tree(*a, **kw).withColumn(
        "q", F.when(F.col("shard") < 8, F.col("q")).otherwise(0)))
    half = result()
    assert half != rows and 0.45 < sum(r[1] for r in half) / sum(r[1] for r in rows) < 0.55


def test_mix_is_linear_in_sources(spark):
    from netlens.llm import mixing
    df = spark.range(6000).selectExpr("id AS doc_id", "concat('s', id) AS source", "repeat('w ', 1 + cast(id % 9 AS int)) AS text")
    out = mixing.taken(mixing.mix(df)).selectExpr("sum(taken) AS t", "sum(size) AS s", "max(taken / size) AS m").first()
    assert abs(out["t"] - out["s"]) <= 3000 and out["m"] <= 3


def test_split_tree_is_exact(spark):
    from netlens.llm import mixing
    blocks = spark.createDataFrame([(1, 1000), (2, 7), (3, 0), (4, 393)], "place int, q long")
    rows = mixing.split_quotas(blocks, shards=6).collect()
    by_place, by_shard = {}, {}
    for r in rows:
        by_place[r["place"]] = by_place.get(r["place"], 0) + r["q"]
        by_shard[r["shard"]] = by_shard.get(r["shard"], 0) + r["q"]
    assert by_place == {1: 1000, 2: 7, 3: 0, 4: 393}
    assert sorted(by_shard) == list(range(6)) and max(by_shard.values()) - min(by_shard.values()) <= 3
    # means over seeds follow the hypergeometric distribution
    first = [r["q"] for s in range(12) for r in mixing.split_quotas(blocks, 2, seed=s).collect() if r["place"] == 1 and r["shard"] == 0]
    assert 450 < sum(first) / len(first) < 550 and len(set(first)) > 3
