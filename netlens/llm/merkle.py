"""Merkle manifest of a dataset: one digest tree a group, one tree over their roots.

A row is a leaf: the sha256 of its columns, each written as byte count, ``:`` and
value, or ``-`` if null.  Leaves of a group ascend by key; while several nodes
remain, every ``fanout`` consecutive ones (the last run: fewer, even one) become
the sha256 of their hex digests.  The groups' roots, ordered by group (null first,
then UTF-8 bytes), become the root the same way.  A leaf's path holds, level by
level, the siblings on its left and on its right, so ``fold`` leads from a leaf
back to the root without any other row.

Method: lag/lead windows.  A node stands at the row of its first leaf, so at level
l its siblings stand at the fixed offsets j * fanout**l; lag and lead columns,
masked by the node's slot and the length of its run, supply the siblings, and the
first child's row hashes the parent.

Scale: places come from a range sort whose parts are numbered where they lie (a
group's offset in a part is a running sum over at most one row a part and group).
A window then holds one aligned block of about 1,024 nodes, never a group: a block
becomes one node of the next, 1,024 times smaller pass, and its path goes down to
its rows by a join on (group, block).  All levels of a pass share one shuffle and
one sort.  Equal rows are dealt by a tie number, so copies never meet in one task.

Nulls count as ``-`` in a leaf; null keys come first; rows with equal keys are
ordered by leaf, so results do not depend on the order of rows.  A null group is a
group of its own.  Empty texts have the part ``0:``; texts of any length are hashed
where they lie.  Repeated rows are leaves of their own.  An empty table gives no
rows.  Other columns are not read, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.llm.common import materialize

FANOUT = 2
#: Nodes of one window at most (rounded down to a power of the fanout).
BLOCK = 1024


def leaf_digest(*columns: Column) -> Column:
    """The sha256 of the columns, in hex."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def path_digest(path: Column) -> Column:
    """The sha256 of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _placed(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """The nodes with ``pos`` (place in their group ``g`` by ``order``) and ``n`` (the
    group's size) added, and the largest n.  Rows equal in ``order`` are interchangeable."""
    nodes = materialize(nodes.withColumn("_tie", F.monotonically_increasing_id()), "nodes")
    at = F.monotonically_increasing_id()      # part number and place in the part
    ranged = materialize(nodes.orderBy("g", *order, "_tie").drop("_tie").select(
        "*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranged")
    counts = ranged.groupBy("g", "_part").agg(F.count("*").alias("c"), F.min("_at").alias("first"))
    before = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select(
        "g", "_part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("_shift"),
        F.sum("c").over(Window.partitionBy("g")).alias("n")), "offsets")
    most = offsets.agg(F.max("n")).first()[0] or 0
    placed = ranged.join(offsets, ["g", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift"))
    return placed.drop("_part", "_at", "_shift"), most


def _climbed(nodes: DataFrame, levels: int, fanout: int) -> DataFrame:
    """The nodes (g, n, pos, d, ...) with ``path``, the siblings of the levels inside
    their block, and ``up``, the digest that their block becomes."""
    block = fanout ** levels
    w = Window.partitionBy("g", F.expr(f"pos div {block}")).orderBy("pos")
    nodes = nodes.withColumn("d_up", F.col("d"))
    for level in range(levels):
        step = fanout ** level
        lags, leads = [f"_lag{j}" for j in range(1, fanout)], [f"_lead{j}" for j in range(1, fanout)]
        nodes = nodes.select(
            "*", *[F.lag("d_up", j * step).over(w).alias(c) for j, c in enumerate(lags, 1)],
            *[F.lead("d_up", j * step).over(w).alias(c) for j, c in enumerate(leads, 1)])
        node, count = F.expr(f"pos div {step}"), F.expr(f"(n + {step - 1}) div {step}")
        slot = node % fanout
        run = F.least(F.lit(fanout), count - node + slot)
        stands, grows = F.col("pos") % step == 0, count > 1
        left = F.concat(*[F.when(j <= slot, F.col(c)).otherwise("") for j, c in reversed(list(enumerate(lags, 1)))])
        right = F.concat(*[F.when(j < run - slot, F.col(c)).otherwise("") for j, c in enumerate(leads, 1)])
        parent = F.when(grows, F.sha2(F.concat("d_up", right), 256)).otherwise(F.col("d_up"))
        nodes = nodes.withColumns({
            "d_up": F.when(stands & (slot == 0), parent),
            f"_s{level}": F.when(stands & grows, F.struct(left.alias("left"), right.alias("right")))}).drop(*lags, *leads)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = [f"_s{level}" for level in range(levels)]
    nodes = nodes.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in [*sides, "d_up"]})
    path = F.filter(F.array(*sides), lambda s: s.isNotNull())
    return nodes.withColumnRenamed("d_up", "up").withColumn("path", path).drop(*sides)


def _tree(nodes: DataFrame, most: int, fanout: int) -> tuple[DataFrame, DataFrame]:
    """The nodes (g, n, pos, d, ...) with ``path`` and ``top`` up to their group's
    root, and the roots (g, d).  most: the largest n."""
    levels = 1
    while fanout ** (levels + 1) <= BLOCK:
        levels += 1
    block = fanout ** levels
    climbed = _climbed(nodes, levels, fanout)
    heads = materialize(climbed.where(F.col("pos") % block == 0).select(
        "g", F.expr(f"(n + {block - 1}) div {block}").alias("n"), F.expr(f"pos div {block}").alias("pos"),
        F.col("up").alias("d")), "heads")
    if most <= block:
        return climbed.withColumnRenamed("up", "top"), heads.select("g", "d")
    above, roots = _tree(heads, -(-most // block), fanout)
    above = materialize(above.select("g", F.col("pos").alias("_block"), F.col("path").alias("_rest"), "top"), "paths")
    rows = climbed.drop("up").withColumn("_block", F.expr(f"pos div {block}")).join(above, ["g", "_block"])
    return rows.withColumn("path", F.concat("path", "_rest")).drop("_rest", "_block"), roots


def manifest(df: DataFrame, key: str = "doc_id", group: str = "lang", columns: list[str] | None = None,
             carry: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``df``: key, group, the ``carry`` expressions over its
    columns, leaf (of ``columns``, all of them by default), path, subroot and root."""
    if fanout < 2:
        raise ValueError("a node needs two children at least")
    carry = carry or {}
    nodes = df.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("g"),   # '-' sorts before '='
        F.col(key).alias("k"), leaf_digest(*[F.col(c) for c in columns or df.columns]).alias("d"),
        F.struct(F.lit(0).alias("_"), *[c.alias(name) for name, c in carry.items()]).alias("carried"))
    placed, most = _placed(nodes, ["k", "d"])
    rows, subroots = _tree(placed, most, fanout)
    tops, groups = _placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("k"), "d"), ["k"])
    tops, _ = _tree(tops, groups, fanout)
    tops = materialize(tops.select(F.col("k").alias("g"), F.col("path").alias("_rest"), F.col("top").alias("root")), "group_paths")
    return rows.join(tops, "g").select(
        F.col("k").alias(key), F.when(F.col("g") != "-", F.substring("g", 2, 1 << 30)).alias(group),
        *[F.col("carried")[name].alias(name) for name in carry],
        F.col("d").alias("leaf"), F.concat("path", "_rest").alias("path"), F.col("top").alias("subroot"), "root")


def verify(rows: DataFrame, leaf: str = "leaf") -> DataFrame:
    """The manifest rows with ``folded_root``, recomputed from ``leaf`` along the
    path, and ``verified``, whether it is the root."""
    return rows.withColumn("folded_root", fold(F.col(leaf), F.col("path"))).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
