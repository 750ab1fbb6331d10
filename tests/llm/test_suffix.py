"""Repeated byte strings against a brute-force walk over all windows."""
import hashlib
import random

import numpy as np
import pytest

from netlens.llm import suffix


def brute(rows, length=100):
    """{row index: (n_bytes, n_removed, n_spans, sha256)}; rows equal in id and text are one document."""
    order = sorted(set((-(1 << 63) if d is None else d, t or "") for d, t in rows), key=lambda x: x[0])
    seen, result = set(), {}
    for d, t in order:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                gone[i:i + length] = True
            seen.add(w)
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        result[d, t] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return [result[(-(1 << 63) if d is None else d, t or "")] for d, t in rows]


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 8)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(40) for _ in range(4)]
    rows = []
    for i in range(n):
        kind = i % 6
        text = prose(rng.randint(5, 60))
        if kind == 1:
            text += " " + shared[i % 4] + " " + prose(20)
        elif kind == 2 and rows:
            text = rows[rng.randrange(len(rows))][1] or ""
        elif kind == 3 and rows:
            words = (rows[rng.randrange(len(rows))][1] or "").split(" ")
            words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        elif kind == 4:
            text = shared[i % 4] * 2 + text + shared[(i + 1) % 4]
        rows.append((i, text))
    rows += [(n, "a" * 400), (n + 1, "x" + "a" * 250 + "b"), (n + 2, "ab" * 150), (n + 3, None), (n + 4, ""), (n + 5, "short"),
             (n + 6, "z" * 99), (n + 7, "z" * 100), (n + 8, "z" * 101), (None, shared[0] + "tail"), (7, rows[7][1])]
    rng.shuffle(rows)
    return rows


def as_rows(df, rows):
    got = {(r["doc_id"], r["n_bytes"], r["kept_sha256"]): (r["n_removed"], r["n_spans"]) for r in df.collect()}
    return got


@pytest.mark.parametrize("hot_rows", [20_000, 3])
def test_matches_brute_force(spark, hot_rows):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, slice string, n int").repartition(5)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
                 for r in suffix.remove(df, hot_rows=hot_rows).collect())
    want = sorted((str(d), *w) for (d, _), w in zip(rows, brute(rows)))
    assert got == want
    assert sum(w[2] for w in want) > 1000


@pytest.mark.parametrize("kind", ["string", "decimal(20,1)"])
def test_keys_of_other_types(spark, kind):
    """Text keys sort by their bytes ("10" before "9"), decimals by value; a null key comes first,
    repeated ones tie by their text, and columns named as the operator's own do no harm."""
    rows = corpus(5, 24)
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "id long, text string, o1 string, runs int").repartition(4)
    df = df.withColumn("doc_id", df["id"].cast(kind)).withColumn("place", df["o1"]).drop("id")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove(df).collect())
    names = sorted({d for d, _ in rows if d is not None}, key=str if kind == "string" else int)
    order = {d: i for i, d in enumerate(names)}
    shown = {d: str(d) if kind == "string" else f"{d}.0" for d in names} | {None: "None"}
    want = brute([(order.get(d), t) for d, t in rows])
    assert got == sorted((shown[d], *w) for (d, _), w in zip(rows, want))
    assert sum(w[2] for w in got) > 300


def test_every_period(spark):
    """A block that recurs at once, of every size up to one more than a window."""
    rng = random.Random(11)
    rows = [(p, "".join(rng.choice("abcdefghij") for _ in range(p)) * (2 + 200 // p)) for p in range(1, 102)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in suffix.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: w for (d, _), w in zip(rows, brute(rows))}
    assert all(w[1] for w in got.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.remove(df).collect() == []


def test_kept_bytes(spark):
    text = "once upon a time " * 20
    df = spark.createDataFrame([(1, text), (2, text + "new end")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in suffix.remove(df, with_text=True).collect()}
    assert out[2]["kept"] == b"new end" or out[2]["kept"].endswith(b"new end")
    assert out[1]["n_removed"] + len(out[1]["kept"]) == out[1]["n_bytes"]


def test_order_is_a_suffix_order():
    rng = np.random.default_rng(1)
    pieces = [bytes(rng.integers(97, 99, 150).astype(np.uint8)) for _ in range(20)]
    n = np.full(20, 51)
    owner, offset, group = suffix.window_classes(pieces, n, 100)
    windows = [pieces[o][i:i + 100] for o, i in zip(owner, offset)]
    assert len(windows) == 20 * 51 and windows == sorted(windows)
    assert all((a == b) == (g == h) for a, b, g, h in zip(windows, windows[1:], group, group[1:]))
