"""Exact quantiles of a column by distributed radix selection.

Every value gets a 64-bit key in the order of the doubles: the bits of the number,
all flipped for negative ones, the sign bit alone for the others.  A pass counts the
next 16 bits of the keys that share the digits found so far and steps into the digit
that holds the wanted rank, so four passes give the value of any rank exactly, with no
sort and whatever the distribution.  A pass is one aggregate, combined before its
shuffle; the driver sees at most 2^16 counts for each wanted rank.

Nulls are left out, NaN is the largest value, -0.0 equals 0.0; between two ranks the
quantile is interpolated linearly.  A column without values has no quantile (None).
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.session import cut_lineage

DIGIT_BITS = 16
_SIGN = np.uint64(1 << 63)


@F.arrow_udf(T.LongType())
def _ordered_key(x: pa.Array) -> pa.Array:
    """Longs in the order of the doubles (as signed numbers)."""
    v = x.to_numpy(zero_copy_only=False).astype("float64") + 0.0          # -0.0 -> 0.0
    v[np.isnan(v)] = np.nan                                                # one NaN, above infinity
    bits = v.view(np.uint64)
    ordered = np.where(bits & _SIGN, ~bits, bits | _SIGN)
    return pa.array((ordered ^ _SIGN).view(np.int64))


def _value(key: int) -> float:
    """The double that has this key (unsigned, in order)."""
    bits = key & ~(1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


def _select(keys: DataFrame, ranks: list[int]) -> dict[int, float]:
    """The values at these ranks (from 0) of a ``key`` column."""
    at = {r: (0, r) for r in ranks}                        # rank -> digits so far, rank among their keys
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        # keys are signed: flipping the sign bit leaves the unsigned order's digits
        plain = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
        digit = F.shiftrightunsigned(plain, shift).bitwiseAND((1 << DIGIT_BITS) - 1)
        found = sorted({p for p, _ in at.values()})
        if shift + DIGIT_BITS == 64:
            rows = keys.groupBy(F.lit(0).cast("long").alias("p"), digit.alias("d"))
        else:
            prefix = F.shiftrightunsigned(plain, shift + DIGIT_BITS)
            rows = keys.where(prefix.isin(found)).groupBy(prefix.alias("p"), digit.alias("d"))
        counts: dict[int, list] = {}
        for r in rows.count().collect():                   # at most 2^16 a prefix
            counts.setdefault(r["p"], []).append((r["d"], r["count"]))
        for rank, (p, left) in list(at.items()):
            for d, n in sorted(counts[p]):
                if left < n:
                    at[rank] = (p << DIGIT_BITS | d, left)
                    break
                left -= n
    return {rank: _value(p) for rank, (p, _) in at.items()}


def exact_quantiles(df: DataFrame, column: str, qs: list[float]) -> list[float | None]:
    """The exact quantiles of a numeric column, linear between neighbours."""
    keys = cut_lineage(df.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull())
                         .select(_ordered_key("x").alias("key")))
    n = keys.count()
    if n == 0:
        return [None] * len(qs)
    places = [q * (n - 1) for q in qs]
    value = _select(keys, sorted({r for h in places for r in (math.floor(h), math.ceil(h))}))
    out = []
    for h in places:
        lo, hi = value[math.floor(h)], value[math.ceil(h)]
        out.append(lo if lo == hi else lo + (hi - lo) * (h - math.floor(h)))
    return out
