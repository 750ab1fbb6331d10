"""SimHash, vector pairs, components and archives against brute force."""
import hashlib
import math
import random
import struct

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from netlens.llm import covertree, simhash, warc
from netlens.llm.components import components
from netlens.sources.fs import resolve


def sets_of(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    import re
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_equals_plain_form():
    rng = random.Random(2)
    parts = ["The", "QUICK", "brÖwn", " ", "\t", "\x0b", "\n", "fox", "\x1c", "\xa0", "a", " "]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("one two " * 20_000) == plain_fingerprint("one two " * 20_000)


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(300)]
    fps += [f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for f in fps]
    tree = simhash.BkTree()
    for f in fps:
        tree.add(f)
    for f in fps[::7]:
        assert sorted(set(tree.within(f, 3))) == sorted({g for g in fps if (f ^ g).bit_count() <= 3})


@pytest.mark.parametrize("shard_rows,blocks", [(512, 4), (8, 4), (512, 6)])
def test_links_are_complete(spark, shard_rows, blocks):
    rng = random.Random(6)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40])):       # some crowded neighbourhoods
            fps.add(f)
            f ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(4)
    found = simhash.links(df, 3, blocks, shard_rows).collect()
    mask = (1 << 64) - 1
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3]
    assert sets_of(fps, [(r["a"] & mask, r["b"] & mask) for r in found]) == sets_of(fps, pairs)


def test_simhash_cluster(spark):
    texts = [None, "", "a b c d e f g h", "A B C D E F G H", "other words stand here now", None, "x"]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, "x", "k", 1), (2, "a b c d e f g h", "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, fp int")
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.cluster(df).collect())
    least = {f"{plain_fingerprint(t):016x}": min(d for d, u, *_ in rows if d is not None and plain_fingerprint(u) == plain_fingerprint(t))
             for _, t, *_ in rows}
    assert got == sorted((str(d), f"{plain_fingerprint(t):016x}", least[f"{plain_fingerprint(t):016x}"]) for d, t, *_ in rows)
    assert simhash.cluster(df.where("doc_id > 99")).collect() == []


def test_components(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(300, 400)] + [(7, rng.randrange(1000, 1300)) for _ in range(300)]
    pairs += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(200)] + [(5, 5), (-3, 7)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    want = {n: r for n, r in sets_of({x for p in pairs for x in p}, pairs).items()}
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {n: r for n, r in want.items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert components(df.where("a > 9999")).collect() == []


def vectors(seed=1, dim=64):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((260, dim))
    near = [x[i % 40] + rng.standard_normal(dim) * rng.uniform(0.05, 0.45) for i in range(160)]
    crowd = [x[3] + rng.standard_normal(dim) * 0.02 for _ in range(80)]
    rows = [list(map(float, v)) for v in [*x, *near, *crowd, x[0], x[0] * 2, x[0], -x[0]]]
    return rows


def brute_vectors(rows, t=0.95):
    ok = {i: np.array(v, float) for i, v in rows
          if v and all(c is not None and math.isfinite(c) for c in v) and any(c != 0 for c in v)}
    pairs = [(i, j) for i in ok for j in ok if i < j and len(ok[i]) == len(ok[j])
             and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= t]
    root, n = sets_of([i for i, _ in rows], pairs), {i: 0 for i, _ in rows}
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    return {i: (n[i], root[i]) for i, _ in rows}


@pytest.mark.parametrize("cell,chunk,leaf", [(1024, 4096, 512), (64, 50, 8)])
def test_vector_pairs(spark, monkeypatch, cell, chunk, leaf):
    for name, value in (("CELL_ROWS", cell), ("CHUNK_ROWS", chunk), ("LEAF_ROWS", leaf)):
        monkeypatch.setattr(covertree, name, value)
    rows = list(enumerate(vectors()))
    odd = [None, [], [0.0] * 64, [1.0, None] + [0.0] * 62, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0], [3.0]]
    rows += list(enumerate(odd, start=len(rows)))
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(i, v, "n", 2) for i, v in rows], "vec_id long, embedding array<double>, node string, mult int").repartition(5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in covertree.cluster(df).collect()}
    assert got == brute_vectors(rows)


@pytest.mark.parametrize("leaf,crossed", [(4, False), (32, False), (4, True)])
def test_cell_equals_brute_force(monkeypatch, leaf, crossed):
    """Deep trees in one process: every part's links add up to the brute-force pairs."""
    monkeypatch.setattr(covertree, "LEAF_ROWS", leaf)
    raw = np.array(vectors(7))
    raw = raw[np.unique(raw, axis=0, return_index=True)[1]]
    rng = np.random.default_rng(2)
    chunk, mult = rng.integers(0, 2, len(raw)), rng.integers(1, 4, len(raw))
    total, pairs = np.zeros(len(raw), np.int64), []
    for part in range(8):
        n, root = covertree.link_cell(raw, part, 8, np.ones(len(raw), bool), chunk, crossed, mult, 0.95)
        total += n
        pairs += list(enumerate(root.tolist()))
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    if crossed:
        near &= chunk[:, None] != chunk[None, :]
    assert (total == near @ mult).all()
    rows = range(len(raw))
    assert sets_of(rows, pairs) == sets_of(rows, [(int(i), int(j)) for i, j in zip(*np.nonzero(near))])


def test_vectors_in_single_precision_and_empty(spark):
    rows = list(enumerate(np.float32(vectors(5)).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in covertree.cluster(df).collect()}
    assert got == brute_vectors(rows)
    assert covertree.cluster(df.where("vec_id < 0")).collect() == []


def pages(spark):
    big, long_ = "x" * 1000, "é" * 600_000
    rows = [(1, "http://a/", big), (2, "http://b/\r\nInjected: 1", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "small"),
            (7, "u", "small"), (8, "ü", long_), (9, "u", long_), (10, "u", "x" * 999), (11, "u", "x" * 999), (None, "u", big),
            (12, "u", "\r\n\r\nWARC/1.1\r\n" + "y" * 2000), (12, "u", "\r\n\r\nWARC/1.1\r\n" + "y" * 2000)]
    return spark.createDataFrame([(*r, "k", 3) for r in rows], "page_id long, url string, html string, kind string, payload int"), rows


def test_archive_round_trip(spark, monkeypatch):
    df, rows = pages(spark)
    got = warc.read_archives(spark, warc.write_archives(warc.plan_records(df))).collect()
    assert len(got) == len(rows) and all(r["error"] is None for r in got)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            first[h] = max(i, first.get(h, i))
    want = sorted((str(i).replace("None", "null"), "revisit" if (h in first and i != first[h]) else "response",
                   str(first[h]) if h in first and i != first[h] else None, len((h or "").encode()),
                   hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows)
    assert sorted((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got) == want
    html = {str(i): h or "" for i, _, h in rows}
    assert all(bytes(r["payload"]).decode() == html[r["record_id"]] for r in got if r["record_type"] == "response")
    assert warc.read_archives(spark, warc.write_archives(warc.plan_records(df.where("page_id > 99")))).collect() == []


def test_archives_have_dictionaries_and_roll(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, "http://x/", " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(rng.randrange(99)) for _ in range(200)))
            for i in range(800)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    paths = warc.write_archives(warc.plan_records(df)).collect()
    fs, p = resolve(paths[0]["path"])
    head = fs.open_input_stream(p).read()
    magic, size = struct.unpack("<II", head[:8])
    assert magic == warc.DICT_MAGIC and size > 1000
    with pytest.raises(zstandard.ZstdError):          # records need the dictionary
        zstandard.ZstdDecompressor().decompress(head[8 + size:8 + size + 4000])
    assert len(list(warc.frames(fs.open_input_stream(p).read))) == 800


def damaged(spark, change):
    folder = warc.shared_path(spark, "damaged")
    path = f"{folder}/x.warc.zst"
    fs, p = resolve(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    good = warc.record("1", "http://a/", b"payload" * 300, "response", None)
    with fs.open_output_stream(p) as f:
        f.write(struct.pack("<II", warc.DICT_MAGIC, 0))
        for data in (good, change(good), good):
            f.write(zstandard.ZstdCompressor().compress(data))
    return spark.createDataFrame([(path,)], "path string")


@pytest.mark.parametrize("change", [
    lambda d: d.replace(b"WARC/1.1", b"WARC/9.9"), lambda d: d.replace(b"WARC-Date", b"WARC-Dote"), lambda d: d[:-1],
    lambda d: d + b"x", lambda d: d.replace(b"payloadpayload", b"PAYLOADpayload", 1),
    lambda d: d.replace(b"Content-Length: 2100", b"Content-Length: 2101")])
def test_bad_records_are_reported(spark, change):
    paths = damaged(spark, change)
    rows = warc.read_archives(spark, paths, strict=False).collect()
    assert [r["error"] is None for r in rows] == [True, False, True]
    with pytest.raises(Exception, match="ArchiveError"):
        warc.read_archives(spark, paths).collect()


def test_cut_archive(spark):
    data = zstandard.ZstdCompressor().compress(b"x" * 100)
    chunks = iter([data[:-3], b""])
    with pytest.raises(warc.ArchiveError):
        list(warc.frames(lambda n: next(chunks, b"")))
