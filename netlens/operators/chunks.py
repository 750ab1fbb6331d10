"""Exact chunk ids of a packet table (W2), without walking a capture in one task.

The rule restarts its byte counter: the record that reaches the limit opens the next
chunk and is not counted in it.  With ``run``, the running bytes of a capture, and
``need``, the running bytes at which the open chunk ends, a chunk opens at the first
record with ``run >= need`` and sets ``need = run + limit``.  Where a chunk opens thus
depends on all chunks before it.

* Captures are cut into blocks of ``span`` limits of running bytes.  A block is a
  function (need on entry) -> (chunks opened inside, need on exit).  Only records within
  one limit of a block's begin can be the first to open a chunk there, so its table of
  jumps is short, and it is made for all blocks at once, each from its own records.
* ``fan`` neighbouring tables are joined into one, level by level, until a capture is
  one table: each entry follows the tables in turn.  Blocks that no chunk opens in
  pass ``need`` on.
* Back down, each table's entry state (chunks so far, need) gives those of the tables
  it was joined from.  At the bottom a block walks its own chunks, at most ``span`` + 1.

Levels grow with the logarithm of a capture's blocks; each is written to the checkpoint
folder.  A task holds one block's sizes or ``fan`` tables, whatever the capture's size.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.operators.flows import running_bytes
from netlens.operators.joins import join_small
from netlens.schema import CHUNK_BYTES
from netlens.session import cut_lineage

SPAN = 16                        # limits of bytes in a block
FAN = 16                         # tables joined into one
TABLE = "source string, block long, run long, opened long, need long"
STATE = "source string, block long, opened_in long, need_in long"
OPENS = "source string, block long, opened_in long, opens array<long>"


def _enter(table: pd.DataFrame, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks opened, need on exit) of a table for each need on entry."""
    at = np.searchsorted(table["run"].to_numpy(), need)
    hit = at < len(table)
    at = np.minimum(at, len(table) - 1)
    return np.where(hit, table["opened"].to_numpy()[at], 0), np.where(hit, table["need"].to_numpy()[at], need)


def _first(run: np.ndarray, begin: int, limit: int) -> int:
    """How many of a block's records can be the first to open a chunk in it."""
    return int(np.searchsorted(run, begin + limit)) + 1


def _jumps(limit: int, width: int):
    def jumps(key, rows: pd.DataFrame) -> pd.DataFrame:
        run = np.sort(rows["run"].to_numpy())
        entry = run[:_first(run, key[1] * width, limit)]
        opened, need = np.ones(len(entry), np.int64), entry + limit
        while True:                  # at most span + 1 steps, a limit of bytes each
            at = np.searchsorted(run, need)
            live = at < len(run)
            if not live.any():
                return pd.DataFrame({"source": key[0], "block": key[1], "run": entry, "opened": opened, "need": need})
            opened[live] += 1
            need[live] = run[at[live]] + limit
    return jumps


def _tables(rows: pd.DataFrame) -> list[tuple[int, pd.DataFrame]]:
    return list(rows.sort_values(["block", "run"]).groupby("block", sort=True))


def _join(limit: int, width: int):
    """Neighbouring tables as one; ``width`` is the joined block's."""
    def join(key, rows: pd.DataFrame) -> pd.DataFrame:
        tables, out = [t for _, t in _tables(rows)], []
        for i, t in enumerate(tables):   # what no record of a table catches goes on to the next
            opened, need = t["opened"].to_numpy(), t["need"].to_numpy()
            for later in tables[i + 1:]:
                more, need = _enter(later, need)
                opened = opened + more
            out.append(pd.DataFrame({"source": key[0], "block": key[1], "run": t["run"], "opened": opened, "need": need}))
            if t["run"].iloc[-1] >= key[1] * width + limit:
                break
        whole = pd.concat(out)
        return whole[:_first(whole["run"].to_numpy(), key[1] * width, limit)]
    return join


def _hand_down(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Entry state of each table from that of the block they were joined into."""
    opened, need, out = int(rows["opened_in"].iloc[0]), np.array([rows["need_in"].iloc[0]]), []
    for block, t in _tables(rows):
        out.append((key[0], block, opened, int(need[0])))
        more, need = _enter(t, need)
        opened += int(more[0])
    return pd.DataFrame(out, columns=["source", "block", "opened_in", "need_in"])


def _walk(limit: int):
    def walk(key, rows: pd.DataFrame) -> pd.DataFrame:
        run, need, opens = np.sort(rows["run"].to_numpy()), rows["need_in"].iloc[0], []
        while (at := np.searchsorted(run, need)) < len(run):
            opens.append(int(run[at]))
            need = run[at] + limit
        return pd.DataFrame({"source": [key[0]], "block": [key[1]], "opened_in": [rows["opened_in"].iloc[0]], "opens": [opens]})
    return walk


def chunk_opens(sizes: DataFrame, limit_bytes: int, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """(source, block, chunks opened before it, ``run`` of the records that open one in it)
    from a written table ``source, block, run`` of the records that have bytes."""
    width = span * limit_bytes
    levels = [cut_lineage(sizes.groupBy("source", "block").applyInPandas(_jumps(limit_bytes, width), TABLE))]
    top = sizes.agg(F.max("block")).first()[0] or 0
    while top > 0:
        width, top = width * fan, top // fan
        up = F.floor(F.col("block") / F.lit(fan)).cast("long")
        levels.append(cut_lineage(levels[-1].withColumn("up", up).groupBy("source", "up")
                                  .applyInPandas(_join(limit_bytes, width), TABLE)))
    state = levels.pop().select("source", "block", F.lit(0).cast("long").alias("opened_in"),
                                F.lit(limit_bytes).cast("long").alias("need_in")).distinct()
    for tables in reversed(levels):
        up = tables.withColumn("up", F.floor(F.col("block") / F.lit(fan)).cast("long"))
        known = state.select("source", F.col("block").alias("up"), "opened_in", "need_in")
        state = cut_lineage(join_small(up, known, ["source", "up"]).groupBy("source", "up").applyInPandas(_hand_down, STATE))
    return join_small(sizes, state, ["source", "block"]).groupBy("source", "block").applyInPandas(_walk(limit_bytes), OPENS)


def with_exact_chunk(packets: DataFrame, limit_bytes: int = CHUNK_BYTES, span: int = SPAN, fan: int = FAN,
                     block_rows: int = 1 << 20, order: str = "packet_no", size: str = "frame_len") -> DataFrame:
    """``chunk_id`` as the capture reader counts it, for a table of packets.

    Adds ``kept_pos`` and ``record_no`` as :func:`netlens.operators.flows.with_chunk` does,
    so windows go on from either.  Every record counts, kept or not; a null size counts
    nothing.  ``source`` must not be null and ``order`` must be unique in it.  Any record
    may be larger than the limit (it opens one chunk); a limit below 1 is refused.
    """
    if limit_bytes < 1 or span < 1 or fan < 2:
        raise ValueError("limit_bytes and span are at least 1, fan at least 2")
    block = F.floor(F.col("run_bytes") / F.lit(span * limit_bytes)).cast("long")
    p = running_bytes(packets, block_rows, order, F.coalesce(F.col(size), F.lit(0)).cast("long")).withColumn("_block", block)
    sizes = cut_lineage(p.filter(F.col(size) > 0).select("source", F.col("_block").alias("block"), F.col("run_bytes").alias("run")))
    opens = chunk_opens(sizes, limit_bytes, span, fan).withColumnsRenamed({"block": "_block", "opened_in": "_before", "opens": "_opens"})
    inside = F.size(F.filter("_opens", lambda x: x <= F.col("run_bytes")))
    return (join_small(p, opens, ["source", "_block"], "left")
            .withColumn("chunk_id", F.coalesce(F.col("_before") + inside, F.lit(0)).cast("long"))
            .drop("_block", "_before", "_opens", "run_bytes"))
