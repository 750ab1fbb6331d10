"""SimHash near-duplicates, linked through BK-trees.

A fingerprint bit is set if it is set in over half the 64-bit hashes of a text's
word shingles.  Two fingerprints link at ``radius`` or fewer differing bits.

Trees are sharded without loss: the 64 bits are cut into ``blocks`` runs, and two
fingerprints within the radius agree on at least ``blocks - radius`` of them.  A
shard is one choice of that many runs with their values; every distinct
fingerprint goes to the shard of each choice, and each shard is one BK-tree
(children keyed by their Hamming distance to the parent; a search follows only
the edges within the radius).  A shard with more than ``shard_rows`` members is
cut into chunks: each chunk's tree is handed to every chunk's queries as a task
of its own, so no shard is one task however many copies crowd into it.  A task
joins what it finds with union-find and emits one link per member, never all
pairs.  Larger corpora take more blocks (4: 16-bit shards, 6: 32-bit shards).

Equal fingerprints are one tree member; empty and null texts have fingerprint
zero.  Very long texts are hashed whole.  Null keys take part in links and get
their component's smallest key.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import materialize, slices
from netlens.llm.components import components

SEED = 42
SHINGLE = 3
RADIUS = 3
BLOCKS = 4
SHARD_ROWS = 512


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    # bytes.lower() and bytes.split() know exactly A-Z and the six ASCII blanks
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    h, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 8192):
        bits = np.unpackbits(hashes[k:k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp bigint: the 64 bits as a signed number) for every row."""
    src = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = src.schema["key"].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            fps = np.fromiter((fingerprint(t, shingle) for t in b["text"].to_pylist()), np.uint64, b.num_rows)
            yield pa.record_batch([b["key"], pa.array(fps.view(np.int64))], names=["key", "fp"])

    return src.mapInArrow(run, f"key {kind}, fp bigint").withColumnRenamed("key", key)


class BkTree:
    """node: [fingerprint, {distance: child}]"""

    def __init__(self):
        self.root = None

    def add(self, fp: int) -> None:
        if self.root is None:
            self.root = [fp, {}]
            return
        node = self.root
        while d := (node[0] ^ fp).bit_count():
            if d not in node[1]:
                node[1][d] = [fp, {}]
                return
            node = node[1][d]

    def within(self, fp: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            at, children = todo.pop()
            d = (at ^ fp).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in children.items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found


TREE_AND_QUERY, TREE, QUERY = 0, 1, 2


def _link_cell(fps, sides, radius: int, links: list) -> None:
    """One task cell: tree members come first; links gets (member, root of its set)."""
    parent: dict[int, int] = {}

    def find(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    tree = BkTree()
    for fp, side in zip(fps, sides):
        if side != TREE:
            for other in tree.within(fp, radius):
                a, b = find(fp), find(other)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        if side != QUERY:
            tree.add(fp)
    links += [(x, find(x)) for x in list(parent)]


def _cells(fps: DataFrame, radius: int, blocks: int, shard_rows: int) -> DataFrame:
    """(cell, side, fp): every fingerprint once per shard, more often in crowded shards."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    runs = [F.shiftrightunsigned(F.shiftleft("fp", 64 - hi), 64 - hi + lo) for lo, hi in zip(edges, edges[1:])]
    choices = [F.xxhash64(F.lit(k), *[runs[i] for i in own])
               for k, own in enumerate(combinations(range(blocks), blocks - radius))]
    sharded = fps.select("fp", F.explode(F.array(*choices)).alias("shard"))
    crowded = materialize(sharded.groupBy("shard").count().where(F.col("count") > shard_rows)
                          .select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("parts")), "crowded")
    dealt = sharded.join(crowded, "shard", "left").select(
        "fp", "shard", F.coalesce("parts", F.lit(1)).alias("parts"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("parts")).cast("int"))
    other = dealt.select("fp", "shard", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return other.select(
        F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        F.when(F.col("own") == F.col("other"), TREE_AND_QUERY)
         .when(F.col("own") < F.col("other"), TREE).otherwise(QUERY).alias("side"), "fp")


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links that join exactly the fingerprints within the radius of one
    another into components.  ``fps`` holds distinct fingerprints."""
    cells = _cells(fps, radius, blocks, shard_rows)
    mask = (1 << 64) - 1

    def run(batches):
        cell, fps_, sides = None, [], []
        for b in batches:
            out: list = []
            for c, s, fp in zip(b["cell"].to_pylist(), b["side"].to_pylist(), b["fp"].to_pylist()):
                if c != cell:
                    if len(fps_) > 1:
                        _link_cell(fps_, sides, radius, out)
                    cell, fps_, sides = c, [], []
                fps_.append(fp & mask)
                sides.append(s)
            yield _pairs(out)
        out = []
        if len(fps_) > 1:
            _link_cell(fps_, sides, radius, out)
        yield _pairs(out)

    return (cells.repartition("cell").sortWithinPartitions("cell", "side")
                 .mapInArrow(run, "a bigint, b bigint").where("a <> b"))


def _pairs(out: list):
    pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def cluster(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
            radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(key, fingerprint 16 hex digits, component_id: smallest key reachable)."""
    docs = materialize(fingerprints(df, key, text, shingle), "fingerprints")
    distinct = materialize(docs.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius, blocks))
    named = (distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                     .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # one row a component, then one a fingerprint: written, so that each join below
    # is of two plain shuffles and a crowded component or fingerprint can be split
    named = materialize(named, "named")
    ids = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    by_fp = materialize(named.join(ids, "root").select("fp", "component_id"), "by_fp")
    return docs.join(by_fp, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
