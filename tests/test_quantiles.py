"""Exact quantiles against a sort, on numbers that leave approximate sketches wrong."""
import math
import struct

import numpy as np
import pytest


def test_keys_keep_the_order_of_doubles():
    from netlens.operators.quantiles import _value
    numbers = [-math.inf, -1.5, -1.0, -5e-324, 0.0, 5e-324, 0.25, 1.0, 1e308, math.inf]
    keys = []
    for x in numbers:
        bits = struct.unpack("<Q", struct.pack("<d", x))[0]
        keys.append(bits ^ (1 << 64) - 1 if bits >> 63 else bits | 1 << 63)
    assert keys == sorted(keys) and [_value(k) for k in keys] == numbers


@pytest.mark.parametrize("case", ["normal", "ties", "tiny range", "wide", "one", "negative"])
def test_equals_sort(spark, case):
    from netlens.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(size=5001), "ties": rng.integers(0, 4, 4000).astype(float),
         "tiny range": 1 + rng.integers(0, 50, 3000) * 2.0 ** -52, "wide": 10.0 ** rng.uniform(-300, 300, 2000),
         "one": np.array([7.25]), "negative": -np.abs(rng.normal(size=999))}[case]
    qs = [0.0, 0.013, 0.25, 0.5, 0.95, 1.0]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    got = exact_quantiles(df, "x", qs)
    s = np.sort(x)
    for q, g in zip(qs, got):
        h = q * (len(s) - 1)
        lo, hi = s[math.floor(h)], s[math.ceil(h)]
        assert g == lo + (hi - lo) * (h - math.floor(h)), (q, g)


def test_odd_columns(spark):
    from netlens.operators.quantiles import exact_quantiles
    empty = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(empty, "x", [0.5, 1.0]) == [None, None]
    odd = spark.createDataFrame([(-0.0,), (0.0,), (math.nan,), (math.inf,)], "x double")
    low, mid, high = exact_quantiles(odd, "x", [0.0, 2 / 3, 1.0])
    assert low == 0.0 and mid == math.inf and math.isnan(high)
    assert exact_quantiles(spark.range(11), "id", [0.5]) == [5.0]
