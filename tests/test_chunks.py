"""Exact chunk ids (W2) from a table equal the reader's counter, whatever the block layout."""
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netlens.operators.chunks import _hand_down, _join, _jumps, _walk, with_exact_chunk

SCHEMA = "source string, packet_no long, frame_len long, keep int"


def count(sizes, limit):
    """The rule, one record after the other."""
    chunk = acc = 0
    for n in sizes:
        acc += n or 0
        if acc >= limit:
            chunk, acc = chunk + 1, 0
        yield chunk


def check(spark, captures, limit, **layout):
    rows = [(s, i + 1, n, 1) for s, sizes in captures.items() for i, n in enumerate(sizes)]
    random.Random(1).shuffle(rows)
    got = with_exact_chunk(spark.createDataFrame(rows, SCHEMA).repartition(3), limit, **layout)
    got = {(r["source"], r["packet_no"]): r["chunk_id"] for r in got.collect()}
    want = {(s, i + 1): c for s, sizes in captures.items() for i, c in enumerate(count(sizes, limit))}
    assert got == want


@pytest.mark.parametrize("span, fan", [(3, 5), (16, 16)])
def test_equals_the_sequential_counter(spark, span, fan):
    r = random.Random(7)
    captures = {
        "small": [r.randint(1, 40) for _ in range(3000)],
        "equal": [10] * 500,                                       # boundaries fall on records
        "huge": [r.choice([5, 90, 1000, 9000]) for _ in range(300)],   # records far beyond the limit leave empty blocks
        "zeros": [r.choice([0, 0, 7]) for _ in range(400)],
        "nulls": [None, 60, None, 60, None], "nothing": [0, 0], "one": [100],
        "hot": [r.randint(40, 60) for _ in range(2000)],
    }
    check(spark, captures, 100, span=span, fan=fan, block_rows=64)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=80), st.integers(1, 25), st.integers(1, 3))
def test_tables_of_any_sizes(sizes, limit, span):
    """The tables of a capture, joined in twos and handed down again, open chunks where the counter does."""
    run = np.cumsum(sizes)
    want = [int(r) for r, new in zip(run, np.diff([0, *count(sizes, limit)])) if new]
    width, run = span * limit, np.unique(run[run > 0])
    blocks = {b: pd.DataFrame({"run": run[run // width == b]}) for b in np.unique(run // width)}
    if not blocks:
        return
    levels, w = [{b: _jumps(limit, width)(("c", b), t) for b, t in blocks.items()}], width
    while max(levels[-1]) > 0:
        w *= 2
        ups = {b // 2 for b in levels[-1]}
        levels.append({u: _join(limit, w)(("c", u), pd.concat([t for b, t in levels[-1].items() if b // 2 == u])) for u in ups})
    state = {0: (0, limit)}
    for tables in reversed(levels[:-1]):
        down = {}
        for u, (opened, need) in state.items():
            rows = pd.concat([t for b, t in tables.items() if b // 2 == u]).assign(opened_in=opened, need_in=need)
            down |= {r.block: (r.opened_in, r.need_in) for r in _hand_down(("c", u), rows).itertuples()}
        state = down
    got = []
    for b in sorted(blocks):
        opened, need = state[b]
        assert opened == len(got)
        got += _walk(limit)(("c", b), blocks[b].assign(opened_in=opened, need_in=need))["opens"][0]
    assert got == want


def test_equals_the_capture_reader(spark, tmp_path):
    from netlens.sources.pcap import read_packets
    from tests.test_pcap import FRAMES, write_pcap
    write_pcap(f"{tmp_path}/a.pcap", FRAMES * 40)
    read = read_packets(spark, str(tmp_path), chunk_bytes=300)
    want = {r["packet_no"]: r["chunk_id"] for r in read.collect()}
    sizes = [len(f) for f in FRAMES * 40]
    table = spark.createDataFrame([("a.pcap", i + 1, n, 1) for i, n in enumerate(sizes)], SCHEMA)
    got = {r["packet_no"]: r["chunk_id"] for r in with_exact_chunk(table, 300, span=4, fan=8).collect()}
    assert len(set(want.values())) > 30 and all(got[k] == c for k, c in want.items())


def test_empty_table_and_bad_limit(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert with_exact_chunk(empty, 100).filter(F.col("chunk_id") >= 0).count() == 0
    with pytest.raises(ValueError):
        with_exact_chunk(empty, 0)
