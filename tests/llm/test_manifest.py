"""Merkle manifest, decontamination and centroid clustering against plain forms."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from netlens.llm import centroids, decontaminate, merkle, queries


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves, fanout):
    """Levels of digests, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        d = levels[-1]
        levels.append([sha("".join(d[i:i + fanout])) for i in range(0, len(d), fanout)])
    return levels


def plain_path(levels, pos, fanout):
    out = []
    for d in levels[:-1]:
        start = pos - pos % fanout
        out.append(("".join(d[start:pos]), "".join(d[pos + 1:start + fanout])))
        pos //= fanout
    return out


def plain_manifest(rows, fanout=2):
    groups = {}
    for r in rows:
        leaf = sha("".join(map(part, (r[0], r[3], r[2], r[4], r[1]))))
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf, r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in order}
    top = plain_tree([trees[g][-1][0] for g in order], fanout) if order else []
    out = []
    for place, g in enumerate(order):
        for pos, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = plain_path(trees[g], pos, fanout) + plain_path(top, place, fanout)
            given = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                given = sha("".join(map(part, (r[0], r[3], r[2], r[4] + 1, r[1]))))
            folded = given
            for a, b in path:
                folded = sha(a + folded + b)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, k int, d string, carried int"


def documents(n):
    rng = random.Random(5)
    rows = [(i * 3, "wörter " * (i % 5), "en" if i % 3 else rng.choice(["de", "fr", "é", None, "", "日"]), f"s{i % 4}", i) for i in range(n)]
    rows += [(None, "no id", "en", None, None), (None, "no id, either", "en", None, 3), (7, None, None, None, None), (9, "", "de", "s", 0)]
    rows += [(12, "the same row", "en", "s1", 5)] * 3
    return rows


@pytest.mark.parametrize("n,fanout,block", [(60, 2, 1024), (300, 2, 8), (300, 3, 9), (41, 5, 5), (0, 2, 1024)])
def test_manifest_equals_plain_trees(spark, tmp_path, monkeypatch, n, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle.manifest, "__defaults__", (*merkle.manifest.__defaults__[:-1], fanout))
    rows = documents(n)
    random.Random(n).shuffle(rows)
    spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle(spark, str(tmp_path))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain_manifest(rows, fanout)))


def test_manifest_of_one_leaf_and_of_none(spark, tmp_path):
    one = [(5, "x", "en", "s", 1)]
    spark.createDataFrame([(*one[0], "x", 1, "y", 2)], DOCS).write.parquet(f"{tmp_path}/a/documents.parquet")
    (row,) = queries.op11_merkle(spark, f"{tmp_path}/a").collect()
    assert tuple(row) == plain_manifest(one)[0] and row["root"] == row["subroot"] == row["leaf"] and row["proof_sha256"] == sha("")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert queries.op11_merkle(spark, f"{tmp_path}/b").collect() == []


def test_manifest_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in documents(200)], DOCS).select("doc_id", "text", "lang")
    rows = [sorted(map(str, merkle.manifest(df.repartition(n)).collect())) for n in (1, 7)]
    assert rows[0] == rows[1] and len(rows[0]) == df.count()


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_contamination(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - span + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + span]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i:i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out


def leaky(rng, n_docs, short):
    vocabulary = ["the", "Of", "and", "über", "É", "x1", "42", "日本", "in", "to", "a", "b"]
    passage = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    join = lambda w: rng.choice([" ", "  ", ", ", "\n", "-", "\x7f"]).join(w)
    items = [(i, join(passage(rng.randint(10, 30)))) for i in range(30)]
    items += [(i, items[0][1] + " and more of it") for i in range(30, 34)]        # shared windows
    items += [(3, join(passage(15))), (None, join(passage(12))), (40, None), (41, ""), (42, " .,; ")]
    items += [(50 + n, join(passage(n))) for n in short]
    docs = []
    for i in range(n_docs):
        w = passage(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            _, text = rng.choice(items)
            source = plain_words(text)
            a = rng.randint(0, max(0, len(source) - 8))
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() if x.isascii() and rng.random() < 0.3 else x for x in source[a:a + rng.randint(5, 20)]]
        docs.append((i, join(w)))
    docs += [(None, docs[0][1]), (0, docs[1][1]), (900, None), (901, ""), (902, " ?! ")] + [docs[5]] * 3
    docs += [(903, f"{items[1][1]} " * 400)]
    return docs, items


@pytest.mark.parametrize("short,block", [((), 1 << 21), ((1, 2, 3, 6, 9, 9), 1 << 21), ((4,), 17)])
def test_contamination_equals_brute_force(spark, short, block):
    docs, items = leaky(random.Random(len(short) + 8), 150, short)
    d = spark.createDataFrame([(*x, "a", 1, "b") for x in docs], "doc_id long, text string, words string, h int, t string").repartition(6)
    b = spark.createDataFrame([(*x, "a", 1) for x in items], "item_id long, text string, win string, start int")
    got = decontaminate.contamination(d, b, max_fingerprints=block).drop("spans")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain_contamination(docs, items)))


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    clean = decontaminate.contamination(docs, items.limit(0)).drop("spans").collect()
    assert [tuple(r) for r in clean] == [(1, 2, 0, 0, sha(""), False)]
    assert decontaminate.contamination(docs.limit(0), items).collect() == []
    hit = decontaminate.contamination(docs, items).first()
    assert [tuple(s) for s in hit["spans"]] == [(0, 2)] and hit["n_items"] == 1


def test_every_shared_span_has_a_common_fingerprint(spark):
    rng = random.Random(3)
    shared = [rng.choice("abcdef") for _ in range(10)]
    texts = [([rng.choice("abcdef") for _ in range(rng.randint(0, 30))] + shared + [rng.choice("abcdef") for _ in range(rng.randint(0, 30))],)
             for _ in range(60)]
    rows = decontaminate.fingerprints(spark.createDataFrame(texts, "words array<string>"), [10]).collect()
    by = {}
    for r in rows:
        by.setdefault(tuple(r["words"][r["start"]:r["start"] + 10]), set()).add(r["h"])
    assert all(len(h) == 1 for h in by.values()) and tuple(shared) in by


def plain_clusters(rows, k=16, rounds=3):
    kept = [(key, [int(np.floor(64 * float(x))) for x in v]) for key, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:k]
    cs = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        by = {}
        for _, v in kept:
            by.setdefault(nearest(v)[1], []).append(v)
        cs = [[sum(x) // len(by[j]) for x in zip(*by[j])] if j in by else c for j, c in enumerate(cs)]
    final = [(key, *nearest(v)) for key, v in kept]
    spent = {}
    for _, d, j in final:
        spent[j] = spent.get(j, 0) + d
    return [(key, j, d, spent[j], sum(spent.values()), sha(",".join(map(str, cs[j])))) for key, d, j in final]


VECTORS = "vec_id long, embedding array<float>, label int, key string, comps int, cluster int"


@pytest.mark.parametrize("n", [400, 9, 0])
def test_clusters_equal_plain_form(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(7, 64)) / 8
    rows = [(i, [float(x) for x in (centres[i % 7] + rng.normal(size=64) * rng.choice([0, 0.01, 0.2])).astype(np.float32)]) for i in range(n)]
    if n > 100:
        rows += [rows[0], (0, rows[3][1]), (None, rows[4][1]), (None, rows[5][1]), (500, [3.0e4] * 64), (501, [0.0] * 64)] + [rows[1]] * 50
    odd = [(601, None), (602, []), (603, [0.5] * 63), (604, [0.5] * 65), (605, [None] + [0.5] * 63),
           (606, [float("nan")] + [0.5] * 63), (607, [float("inf")] + [0.5] * 63), (608, [float("-inf")] + [0.5] * 63)]
    spark.createDataFrame([(*r, 1, "a", 2, 3) for r in rows + odd], VECTORS).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_centroids(spark, str(tmp_path))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain_clusters(rows)))


def test_filter_bounds_and_prunes():
    rng = np.random.default_rng(1)
    shape = 100 * 0.8 ** np.arange(64) + 0.5            # variance mostly in the leading axes, where the bound is tight
    x = np.floor(rng.normal(size=(600, 64)) * shape).astype(np.int64)
    c = x[rng.choice(600, 24, replace=False)]
    moments = x.astype(float)
    mean = moments.mean(0)
    axes = np.linalg.eigh(np.cov(moments.T))[1][:, ::-1]
    y, rest = centroids.rotated(moments, mean, axes, 8)
    cy, c_rest = centroids.rotated(c.astype(float), mean, axes, 8)
    exact = ((x[:, None] - c[None]) ** 2).sum(2)
    bound = ((y[:, None] - cy[None]) ** 2).sum(2) + (rest[:, None] - c_rest[None]) ** 2
    assert (bound <= exact + 1e-6).all()
    cluster, distance, verified = centroids.nearest(x, y, rest, c, cy, c_rest)
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert verified < 0.35 * exact.size                 # the filter decides most pairs


def test_too_large_components_raise(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(df)
