"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ...; they
share all words by weight, stop at ``max_epochs`` times their own size, and the
excess is reshared (a water level over the sources, found with running sums).

Quotas: a source's documents are laid end to end in a random order (md5 of seed
and key), over and over; the source's quota is the first round(target) words of
that stream, cut into blocks.  The tree starts with the block quotas of all
sources and halves the output shards level by level: of a node's blocks, exactly
the left half's number is drawn without replacement (the smallest md5 keys), which
splits every source's quota multivariate-hypergeometrically; the rest goes right.
A shard draws the next blocks of each source's permuted stream, as many as its
leaf holds, so shards are disjoint; what the mix takes of a document is what the
shards' blocks hold of it.  ``deal`` puts a shard's rows in a random order of its own.

The blocks end at round(target) words exactly, so ``mix`` takes that many of each
source and no document more than ``max_epochs`` times.  ``deal`` never cuts a text: a
document goes whole to the shard that holds its first word, so each source's rows
exceed its quota by less than one document.

Scale: everything is column expressions.  Rows are numbered by a three-level
running sum (rows in a bucket of about ``BUCKET_ROWS``, buckets in a group, groups
in a source), so a source that holds a third of all rows spreads over many
tasks.  The tree works on quotas, never on rows: at most ``MAX_BLOCKS`` blocks
plus one per source, each looked at once a level.  The source table (one row a
source) is the only thing read in one task.

Rows that keep their text are not written a second time: their sizes are, and the
rows are read again from the input, which must hold the same rows both times.

Null texts have size 0; sources of size 0 take nothing; an empty table gives an
empty mix.  Repeated rows are separate rows of the stream.  Other columns travel
along untouched.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netlens.llm.common import materialize, words

SEED = 17
SHARDS = 16
MAX_EPOCHS = 3
BUCKET_ROWS = 128
GROUP_BUCKETS = 1024
MAX_BLOCKS = 1 << 16


def _sized(df: DataFrame, key: str, text: str, source: str, keep, seed: int) -> DataFrame:
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return df.select(F.struct(*(keep or df.columns)).alias("row"), F.col(source).alias("source"),
                     F.size(words(F.col(text))).cast("long").alias("size"), order.alias("ord"))


def _targets(sized: DataFrame, max_epochs: int) -> DataFrame:
    """One row per source: its place, size, rows, weight and target."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    s = s.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", (F.col("place") - 1) % 3 + 1).withColumn("cap", max_epochs * F.col("source_size"))
    filled = W.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(filled), F.lit(0)))
                     / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0))))
    capped = F.col("weight") * F.col("level") > F.col("cap")
    s = s.withColumn("level", F.max(F.when(~capped, F.col("level"))).over(everything))
    return s.withColumn("target", F.least(F.col("cap").cast("double"),
                                          F.coalesce(F.col("weight") * F.col("level"), F.col("cap").cast("double")))) \
            .withColumn("quota", F.round("target").cast("long"))


def _split(nodes: DataFrame, seed: int) -> DataFrame:
    """One level down: (node, first, shards, blocks) rows to their two halves."""
    left_shards = F.floor(F.col("shards") / 2).cast("int")
    n = nodes.withColumn("draw", F.round(F.size("blocks") * left_shards / F.col("shards")).cast("int"))
    n = n.withColumn("keyed", F.transform("blocks", lambda place, j: F.struct(
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("node").cast("string"), (j + 1).cast("string"))).alias("key"),
        place.alias("place"))))
    n = n.withColumn("last", F.when(F.col("draw") > 0, F.get(F.sort_array(F.transform("keyed", lambda b: b["key"])),
                                                             F.col("draw") - 1)).otherwise(F.lit("")))
    part = lambda test: F.transform(F.filter("keyed", test), lambda b: b["place"]).alias("blocks")
    halves = F.array(
        F.struct((2 * F.col("node") + 1).alias("node"), F.col("first"), left_shards.alias("shards"),
                 part(lambda b: b["key"] <= F.col("last"))),
        F.struct((2 * F.col("node") + 2).alias("node"), (F.col("first") + left_shards).alias("first"),
                 (F.col("shards") - left_shards).alias("shards"), part(lambda b: b["key"] > F.col("last"))))
    whole = F.array(F.struct("node", "first", "shards", "blocks"))
    return n.select(F.explode(F.when(F.col("shards") > 1, halves).otherwise(whole)).alias("x")).select("x.*")


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(place, q) block quotas -> (place, shard, q); shard sizes differ by rounding only."""
    root = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("place", F.col("q").cast("int").alias("q")))).alias("s"))
    # the blocks of all sources in a row, each known by its source's place
    nodes = root.select(F.lit(0).cast("long").alias("node"), F.lit(0).alias("first"), F.lit(shards).alias("shards"),
                        F.flatten(F.transform("s", lambda x: F.array_repeat(x["place"], x["q"]))).alias("blocks"))
    for _ in range(max(0, (shards - 1).bit_length())):
        nodes = _split(nodes, seed)
    drawn = (nodes.select(F.col("first").alias("shard"), F.explode("blocks").alias("place"))
                  .groupBy("place", "shard").agg(F.count(F.lit(1)).alias("q")))
    every = quotas.select("place", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    return every.join(drawn, ["place", "shard"], "left").fillna(0, ["q"])


def _plan(sized: DataFrame, shards: int, max_epochs: int, seed: int) -> DataFrame:
    """The source table with block size and, per source, the words of its stream that each shard draws."""
    s = materialize(_targets(sized, max_epochs), "targets")
    total = F.sum("quota").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    s = s.withColumn("block", F.greatest(F.lit(1), F.ceil(total / MAX_BLOCKS)).cast("long"))
    quotas = split_quotas(s.select("place", F.ceil(F.col("quota") / F.col("block")).cast("long").alias("q")), shards, seed)
    dealt = quotas.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("shard", "q"))).alias("d"))
    blocks = lambda n: F.aggregate(F.slice("d", 1, n), F.lit(0).cast("long"), lambda a, x: a + x["q"])
    word = lambda n: F.least(F.col("quota"), F.col("block") * blocks(n))
    runs = F.transform("d", lambda x, i: F.struct(x["shard"].alias("shard"), word(i).alias("lo"), word(i + 1).alias("hi")))
    return materialize(s.join(dealt, "place").withColumn("runs", runs).drop("d"), "plan")


def _bucketed(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows with their source's plan and their bucket and group in its random order."""
    rows = sized.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    draw: Column = F.conv(F.substring("ord", 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("bucket", F.floor(draw * F.ceil(F.col("rows") / BUCKET_ROWS)).cast("long")) \
               .withColumn("group", F.floor(F.col("bucket") / GROUP_BUCKETS).cast("long"))


def _offsets(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``before``: the words of the source's rows that come earlier in its random order.
    ``sizes``: the same rows, for the sums by bucket."""
    at = ["place", "group", "bucket"]
    totals = materialize(sizes.groupBy(*at).agg(F.sum("size").alias("words")), "buckets")
    groups = totals.groupBy("place", "group").agg(F.sum("words").alias("words"))
    earlier = lambda *by, order: W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    groups = groups.select("place", "group", F.coalesce(F.sum("words").over(earlier("place", order=["group"])), zero).alias("g0"))
    buckets = totals.select(*at, F.coalesce(F.sum("words").over(earlier("place", "group", order=["bucket"])), zero).alias("b0"))
    starts = materialize(buckets.join(groups, ["place", "group"]).select(*at, (F.col("g0") + F.col("b0")).alias("b0")), "starts")
    inside = F.coalesce(F.sum("size").over(earlier(*at, order=["ord", "size"])), zero)
    return rows.withColumn("inside", inside).join(starts, at).withColumn("before", F.col("b0") + F.col("inside"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        keep: list[str] | None = None, shards: int = SHARDS, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED) -> DataFrame:
    """One row per input row: ``row`` (its columns, or those in ``keep``), size, source_size, target and
    ``pieces``: what the mix takes of it, as (epoch, shard, n_words) in epoch order."""
    sized = _sized(df, key, text, source, keep, seed)
    if text in (keep or df.columns):
        sizes = materialize(sized.drop("row"), "sizes")
    else:
        sized = sizes = materialize(sized, "sized")
    plan = _plan(sizes, shards, max_epochs, seed)
    rows = _offsets(_bucketed(sized, plan), _bucketed(sizes, plan))
    start = lambda e: e * F.col("source_size") + F.col("before")
    drawn = lambda e, r: F.least(r["hi"], start(e) + F.col("size")) - F.greatest(r["lo"], start(e))
    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda e: F.transform(
        "runs", lambda r: F.struct(e.alias("epoch"), r["shard"].alias("shard"), drawn(e, r).alias("n_words")))))
    return rows.select("row", "size", "source_size", "target", F.filter(pieces, lambda p: p["n_words"] > 0).alias("pieces"))


def taken(mixed: DataFrame) -> DataFrame:
    """(row, size, source_size, target, taken, shard_words): the words drawn of each row, in all and
    as ``shard:words``, comma-joined by shard."""
    words_of = lambda s: F.aggregate(F.filter("pieces", lambda p: p["shard"] == s), F.lit(0).cast("long"),
                                     lambda a, p: a + p["n_words"])
    shards = F.sort_array(F.array_distinct(F.transform("pieces", lambda p: p["shard"])))
    return mixed.select("row", "size", "source_size", "target", F.aggregate(
        "pieces", F.lit(0).cast("long"), lambda a, p: a + p["n_words"]).alias("taken"),
        F.array_join(F.transform(shards, lambda s: F.concat_ws(":", s.cast("string"), words_of(s).cast("string"))), ",")
         .alias("shard_words"))


def deal(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: a row goes whole, once an epoch that draws words of it, to the shard
    that draws the first of them; the rows of a shard are shuffled."""
    cols = mixed.schema["row"].dataType.names
    first = F.filter("pieces", lambda p, i: (i == 0) | (p["epoch"] != F.get("pieces", i - 1)["epoch"]))
    out = mixed.select("row", F.explode(first).alias("p")) \
               .select("row.*", F.col("p.shard").alias("_shard"),
                       F.xxhash64(F.lit(seed), F.col("p.epoch"), F.col("p.shard"), F.to_json("row")).alias("_order"))
    # a shard is many tasks' work: rows go to a random slot of their shard and are sorted there
    return (out.withColumn("_slot", F.pmod("_order", F.lit(64)))
               .repartition("_shard", "_slot").sortWithinPartitions("_shard", "_slot", "_order").select(*cols))
