"""Quality rules from text counts and cross-document line frequency.

Text counts are column expressions over each row: no shuffle and no Python.
``n_repeat_words`` compares 5-word windows by a 64-bit hash.

Line rule: lines are normalised (lower case, blanks collapsed, ends trimmed) and
hashed; per host the number of distinct documents that hold a line is counted
(documents of equal text count once, so exact copies do not make their lines
frequent).  A line is removed where that number exceeds ``max(min_docs,
max_share * documents of the host)``.  A document is depleted, and rejected, if
fewer than ``min_words`` words or less than ``min_left`` of its words remain.

Scale: the count is one combined aggregate by (host, line); the frequent lines
are written, then met by the lines through a join that adaptive execution
broadcasts only under Spark's size limit and otherwise splits at hot lines.

Null and empty texts have no words, so the base rule rejects them.  A null host
is a host of its own.  Repeated rows get equal verdicts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import BLANK, materialize, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_DOCS = 10
MAX_SHARE = 0.05
MIN_LEFT = 0.3


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, BLANK + "+", " ")))


def text_counts(df: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words added."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_words", words(F.col(text))).withColumn("_all_lines", _lines(F.col(text)))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("_win", F.when(F.col("n_words") >= window, F.transform(
        F.sequence(F.lit(1), F.greatest(F.col("n_words") - window + 1, F.lit(1)).cast("int")),
        lambda i: F.xxhash64(F.slice("_words", i, window)))).otherwise(F.array().cast("array<bigint>")))
    # only texts with an equal pair of windows are sorted: (hash, place), then the places found twice
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(
        F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s, n = F.col("_sorted"), F.size("_sorted")
    df = df.withColumn("_at", F.when(s.isNotNull(), F.sort_array(F.transform(F.filter(
        s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == x["h"]))),
        lambda x: x["i"]))))
    p, m = F.col("_at"), F.size("_at")
    repeat = F.when(p.isNull(), F.lit(0)).otherwise(F.aggregate(
        F.transform(p, lambda x, k: F.when(k < m - 1, F.least(F.get(p, k + 1) - x, F.lit(window))).otherwise(window)),
        F.lit(0), lambda a, x: a + x))
    return df.select(
        "*", F.length(F.regexp_replace(t, BLANK + "+", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_all_lines") - F.size(F.array_distinct("_all_lines"))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words")).drop("_win", "_sorted", "_at", "_words")


def _features(df: DataFrame, key: str, text: str, host: str, min_words: int) -> DataFrame:
    src = df.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text"))
    counted = text_counts(src)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    line = lambda x: F.struct(F.xxhash64(_normal(x)).alias("h"), F.size(words(x)).alias("w"))
    return counted.select(
        "key", F.concat(F.lit("h"), "host").alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.transform("_all_lines", line).alias("lines"),
    ).withColumn("host", F.coalesce("host", F.lit("null")))


def frequent_lines(features: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, h): the lines above their host's limit."""
    docs = features.dropDuplicates(["host", "text_hash"])
    per_host = materialize(docs.groupBy("host").agg(F.count("*").alias("docs")), "hosts")
    counts = (docs.select("host", F.explode(F.array_distinct(F.col("lines.h"))).alias("h"))
                  .groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > min_docs))
    return materialize(materialize(counts, "line_counts").join(per_host, "host")
                       .where(F.col("n") > max_share * F.col("docs")).select("host", "h"), "frequent")


def assess(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
           min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE,
           min_left: float = MIN_LEFT, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: key, text_hash, counts, base_failed, words_removed, removed (line hashes), kept."""
    feats = materialize(_features(df, key, text, host, min_words), "features")
    frequent = frequent_lines(feats, min_docs, max_share)
    hit = (feats.dropDuplicates(["key", "host", "text_hash"])
                .select("key", "host", "text_hash", F.explode("lines").alias("line"))
                .select("key", "host", "text_hash", "line.h", "line.w")
                .join(frequent, ["host", "h"], "left_semi")
                .groupBy("key", "host", "text_hash")
                .agg(F.sum("w").alias("words_removed"), F.collect_set("h").alias("removed")))
    hit = materialize(hit, "hit").withColumnsRenamed({"key": "k", "host": "g", "text_hash": "t"})
    left = F.col("n_words") - F.col("words_removed")
    out = feats.drop("lines").join(hit, F.col("key").eqNullSafe(F.col("k")) & (F.col("host") == F.col("g"))
                                   & (F.col("text_hash") == F.col("t")), "left").drop("k", "g", "t")
    out = out.fillna(0, ["words_removed"])
    kept = ~F.col("base_failed") & (left >= min_words) & (left >= min_left * F.col("n_words"))
    return out.withColumn("kept", kept).withColumnRenamed("key", key)


def apply(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The kept rows of ``df``, its columns as they were, frequent lines taken out of the text."""
    verdict = assess(df, key, text, host, **limits).where("kept").select(
        F.col(key).alias("_k"), F.col("host").alias("_g"), F.col("text_hash").alias("_t"),
        F.coalesce("removed", F.array().cast("array<bigint>")).alias("_gone"))
    verdict = materialize(verdict.dropDuplicates(["_k", "_g", "_t"]), "verdict")
    own_host = F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("null"))
    joined = df.join(verdict, F.col(key).eqNullSafe(F.col("_k")) & (own_host == F.col("_g"))
                     & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_t")))
    cleaned = F.when(F.size("_gone") == 0, F.col(text)).otherwise(F.array_join(F.filter(
        F.split(F.col(text), "\n"), lambda x: ~F.array_contains(F.col("_gone"), F.xxhash64(_normal(x)))), "\n"))
    return joined.select(*[cleaned.alias(c) if c == text else F.col(c) for c in df.columns])
