"""Joins against per-key tables (class plans, held-out sessions, weights).

The small side is an aggregate keyed by the join key (one row per class or
capture).  It is computed once (reliable checkpoint), so that its measured size
decides: under ``max_rows`` rows and ``max_bytes`` bytes it is broadcast, so a
key holding a third of the big side never lands in one task; above that the
join is a shuffle join whose hot keys AQE's skew-join handling splits
(``spark.sql.adaptive.skewJoin.enabled``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.session import cut_lineage

BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 << 20


def is_small(table: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether a written (cut) table may be broadcast, by its measured rows and bytes."""
    size = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))
                     .alias("bytes")).first()
    return size["rows"] <= max_rows and size["bytes"] <= max_bytes


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = BROADCAST_MAX_ROWS,
               max_bytes: int = BROADCAST_MAX_BYTES, measured: bool | None = None) -> DataFrame:
    """Join against a per-key table.  ``measured`` is :func:`is_small` of a written table
    that ``small`` takes its rows from, so nothing is computed here; without it ``small``
    is written and measured first."""
    if measured is None:
        small = cut_lineage(small)
        measured = is_small(small, max_rows, max_bytes)
    return big.join(F.broadcast(small) if measured else small, on, how)
