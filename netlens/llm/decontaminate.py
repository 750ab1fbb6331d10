"""Benchmark decontamination by winnowing, in DataFrame functions only.

An item's windows are its runs of ``span`` consecutive words (an item of fewer, but
not none, is one window).  A document word is hit if it lies in an occurrence of a
window; the document lists the items whose windows occur in it.

Method: winnowing.  Both sides hash their k-grams and keep, for every window, the
least hash of the ``span - gram + 1`` k-grams in it.  Equal windows have equal least
hashes, so each shared span of ``span`` words or more meets in the join of the
fingerprints: nothing is missed.  A document window whose fingerprint is found is
extended to its words, and these are compared with the windows' words, so a hash
never decides.  Items shorter than ``span`` are one window of their own length, so
documents are winnowed for these lengths too (at most ``span`` of them).

Scale: the fingerprints of a document stay with its row.  Those of the benchmark
are met as broadcast blocks of at most ``max_fingerprints`` numbers (one pass over
the documents a block, a benchmark beyond 2 million fingerprints needs several), so
no fingerprint of a clean text is shuffled.  What is shuffled are found windows,
once a text: documents of equal text share their hits.  Windows held by the same
items are one class, and documents that hold the same classes share one item list,
so a passage that a third of all documents and items hold makes no pairs.

A null or empty text has no words; it is clean (0 hits, the digest of no items).
A null or empty item has no window.  Rows that repeat an item_id are one item with
the windows of all of them; an item without an id hits words and is listed nowhere.
Repeated documents get equal rows.  Either table may be empty.  Other columns are
not read, whatever their names.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import materialize

SPAN, GRAM = 10, 5
MAX_FINGERPRINTS = 1 << 21
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, before A-Z become a-z.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in order, A-Z as a-z (null: none)."""
    small = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER))
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), _BETWEEN), lambda w: w != ""), small)


def _over_runs(array: str, length: int, value) -> Column:
    """``value`` of every run of ``length`` consecutive entries."""
    count = F.size(array) - (length - 1)
    starts = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: value([F.get(array, i + j) for j in range(length)]))


def _records(span: int, least: str) -> Column:
    return F.transform(least, lambda h, i: F.struct(F.lit(span).alias("span"), i.alias("start"), h.alias("h")))


def gram_of(span: int, gram: int = GRAM, full: int = SPAN) -> int:
    """The k-gram length for windows of ``span`` words."""
    return gram if span == full else (span + 1) // 2


def fingerprints(df: DataFrame, spans: list[int], full: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The rows (with ``words``), one per window: ``span``, ``start`` and ``h``, the least k-gram hash in it.

    Outer generators, as Spark else pushes a filter on the array down, which computes it again inside itself."""
    df = df.withColumn("_hashes", F.transform("words", lambda w: F.xxhash64(w)))
    per_span = []
    for span in spans:
        k = gram_of(span, gram, full)
        grams, least = f"_grams{span}", f"_least{span}"
        df = df.withColumn(grams, _over_runs("_hashes", k, lambda run: F.xxhash64(F.lit(span), *run)))  # noqa: B023
        df = df.withColumn(least, _over_runs(grams, span - k + 1, lambda run: F.least(*run) if len(run) > 1 else run[0]))
        per_span.append((span, grams, least))
    extra = ["_hashes", *[c for _, *both in per_span for c in both]]
    keep = [c for c in df.columns if c not in extra]
    if len(per_span) == 1:
        span, _, least = per_span[0]
        out = df.select(*keep, F.lit(span).alias("span"), F.posexplode_outer(least).alias("start", "h"))
        return out.where("h is not null")
    rows = F.concat(*[_records(span, least) for span, _, least in per_span])
    return df.select(*keep, F.inline_outer(rows)).where("h is not null")


def _window(span: Column) -> Column:
    return F.array_join(F.slice("words", F.col("start") + 1, span), " ")


def benchmark_windows(items: DataFrame, key: str, text: str, span: int, gram: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Distinct windows (win, h, class), classes (class, item), and the window lengths that occur."""
    src = items.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("words")).where(F.size("words") > 0)
    src = materialize(src, "items")
    lengths = sorted(r[0] for r in src.select(F.least(F.size("words"), F.lit(span)).alias("n")).distinct().collect())
    parts = []
    for n in lengths:
        own = src.where(F.size("words") >= span) if n == span else src.where(F.size("words") == n)
        parts.append(fingerprints(own, [n], span, gram).select("item", _window(F.col("span")).alias("win"), "h"))
    if not parts:
        spark = items.sparkSession
        return (spark.createDataFrame([], "win string, h long, class string"),
                spark.createDataFrame([], "class string, item string"), [])
    found = reduce(DataFrame.unionByName, parts).groupBy("win", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = materialize(found.withColumn("class", F.md5(F.to_json("items"))), "windows")
    classes = materialize(found.select("class", "items").dropDuplicates(["class"])
                               .select("class", F.explode("items").alias("item")), "classes")
    return found.select("win", "h", "class"), classes, lengths


def occurrences(texts: DataFrame, windows: DataFrame, lengths: list[int], span: int, gram: int, max_fingerprints: int) -> DataFrame:
    """(t, start, span, class): where windows occur in the texts (t, words); repeated texts may repeat rows."""
    keys = materialize(windows.select("h").distinct(), "fingerprints")
    blocks = max(1, -(-keys.count() // max_fingerprints))
    found = []
    for b in range(blocks):
        block = keys if blocks == 1 else keys.where(F.pmod(F.hash("h"), F.lit(blocks)) == b)
        met = fingerprints(texts, lengths, span, gram).join(F.broadcast(block), "h", "left_semi")
        found.append(met.select("t", "start", "span", _window(F.col("span")).alias("win")))
    return reduce(DataFrame.unionByName, found).distinct().join(windows.select("win", "class"), "win").drop("win")


def _covered(spans: Column) -> Column:
    """Words inside the union of (start, span) runs, given in order."""
    step = lambda a, x: F.struct(
        F.greatest(a["end"], x["start"] + x["span"]).alias("end"),
        (a["n"] + F.greatest(x["start"] + x["span"] - F.greatest(a["end"], x["start"]), F.lit(0))).alias("n"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"].cast("long")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", span: int = SPAN, gram: int = GRAM,
                  max_fingerprints: int = MAX_FINGERPRINTS) -> DataFrame:
    """One row per document: key, n_words, n_hit, spans (hit windows: start, span), n_items, items_sha256, contaminated."""
    windows, classes, lengths = benchmark_windows(items, item_key, item_text, span, gram)
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    digest = F.md5(F.coalesce("text", F.lit("")))
    base = own.select("k", digest.alias("t"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    nothing = F.array().cast("array<struct<start:int,span:int>>")
    if not lengths:
        hits = base.select("t").where("false").select("t", F.lit(0).cast("long").alias("n_hit"), nothing.alias("spans"), F.lit("").alias("list"))
        lists = hits.select("list", F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items_sha256"))
    else:
        texts = own.select(digest.alias("t"), words(F.col("text")).alias("words"))
        places = occurrences(texts, windows, lengths, span, gram, max_fingerprints)
        per_text = places.groupBy("t").agg(F.sort_array(F.collect_set(F.struct("start", "span"))).alias("spans"),
                                           F.sort_array(F.collect_set("class")).alias("found"))
        hits = materialize(per_text.select("t", "spans", _covered(F.col("spans")).alias("n_hit"), "found",
                                           F.md5(F.array_join("found", ",")).alias("list")), "hits")
        lists = (hits.select("list", "found").dropDuplicates(["list"]).select("list", F.explode("found").alias("class"))
                     .join(classes, "class").groupBy("list").agg(F.sort_array(F.collect_set("item")).alias("items"))
                     .select("list", F.size("items").cast("long").alias("n_items"),
                             F.sha2(F.array_join("items", ","), 256).alias("items_sha256")))
        hits = hits.drop("found")
    lists = materialize(lists, "lists")
    out = base.join(hits, "t", "left").join(lists, "list", "left")
    return out.select(
        F.col("k").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("spans", nothing).alias("spans"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
