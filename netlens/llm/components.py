"""Connected components of a link table, as Spark jobs.

Alternating large-star and small-star rounds: each node's larger neighbours (then
its smaller ones) are re-linked to the smallest node it knows, until nothing
changes.  Every round is two min-aggregates (combined before their shuffle) and
two joins; the minima are written first, so both join sides are plain shuffles
whose hot keys (the centre of a large component) adaptive execution splits.  No
links reach the driver: it sees a row count and a checksum a round.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import materialize

MAX_ROUNDS = 64


def _minima(e: DataFrame) -> DataFrame:
    return materialize(e.groupBy("u").agg(F.min("v").alias("m")), "minima")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _minima(both).select("u", F.least("u", "m").alias("m"))
    return both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    m = _minima(e)
    moved = e.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(m.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node
    reachable.  Self links and repeated links are ignored; nodes that have no
    link to another node are not returned."""
    e = materialize(edges.where("a <> b")
                    .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
        e = materialize(_small_star(materialize(_large_star(e), "large")), "small")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
