"""Exact cosine-threshold pairs of vectors by dual traversal of cover trees.

On unit vectors cosine >= t means a distance of at most r = sqrt(2 - 2t).

The distinct vectors are laid out along a net of centres (from a bounded sample,
in the order of a cover tree over them: it only decides what lies next to what)
and written once, as chunks of bounded size.  Every two chunks are compared where
they are read: the chunk table is joined with itself by reading, so no vector is
shipped or written a second time, however many chunks there are.

A chunk builds a cover tree (nested levels, halving radii, each node with its
covering radius).  Two chunks' trees are traversed against each other, a chunk's
own against itself: a pair of nodes is dropped if their distance exceeds the
radius plus both covering radii, and taken as a whole if it cannot exceed the
radius.  Leaves that remain are compared through their leading runs of rotated
coordinates (a fixed orthogonal matrix, ``parts`` runs; a pair within r is within
r in them too), and what is left is compared in full, in double precision.

Equal vectors are one tree member with a count.  A task emits, per vector, the
number of its links and one link into its set; never the pairs.

Vectors that are null, zero, of no dimension, or hold null or non-finite
components link with nothing.  Vectors of different dimension never link.
"""
from __future__ import annotations

import contextlib
import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm.common import materialize
from netlens.llm.components import components

COSINE = 0.95
PARTS = 8
LEAD = 3 / 8             # share of the runs that leaves are compared by first
CELL_ROWS = 1024         # rows a net centre stands for
MAX_CENTRES = 2048       # bound of the net, and with it of what is broadcast
SAMPLE_PER_CENTRE = 4
NET_GAP = 0.1            # least distance of two centres of a net
CHUNK_ROWS = 16_384
CHUNK_BYTES = 8 << 20    # of a chunk's vectors, where they are long
SPLIT_BYTES = 64 << 20   # of the chunk table, at most, unless that makes more than
MAX_SPLITS = 256         # splits: their square is the number of tasks
LEAF_ROWS = 512
PIVOTS = 64              # centres of a level that are tried at once
BLOCK_ROWS = 512         # rows of a leaf that are compared at once, with as many
BLOCK_PAIRS = 1 << 18    # others as make these pairs
READY = 10               # chunks a task keeps with their trees
SEED = 11
SLACK = 1e-9
SURE = 1e-6              # by so much pairs are closer that count unseen
SINGLE = 2.0 ** -22      # a coordinate: more than single precision loses in a squared distance


@functools.cache
def rotation(dim: int) -> np.ndarray:
    rng = np.random.Generator(np.random.Philox(key=SEED + dim))
    return np.linalg.qr(rng.standard_normal((dim, dim)))[0]


def part_edges(dim: int, parts: int) -> list[int]:
    return [round(dim * i / parts) for i in range(parts + 1)]


def unit_rows(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


class CoverTree:
    """Nested levels over the rows of ``x``, as arrays: per node its centre's row, its
    covering radius, its rows (a run of ``order``) and its children (a run of nodes)."""

    def __init__(self, x: np.ndarray, leaf: int | None = None):
        leaf, square = leaf or LEAF_ROWS, (x * x).sum(axis=1)
        todo: list = [(0, np.arange(len(x)), math.inf)]
        centre, cover, child, end, leaves = [], [], [], [], []
        k = 0
        while k < len(todo):                          # breadth first: children are a run
            c, rows, radius = todo[k]
            reach = float(np.linalg.norm(x[rows] - x[c], axis=1).max(initial=0.0))
            centre.append(c)
            cover.append(reach)
            child.append(len(todo))
            if len(rows) > leaf and reach > 0.0 and radius:
                radius = min(radius, reach)
                while radius >= reach:
                    radius /= 2                       # skip the levels that hold one node only
                todo += self._level(x, square, rows, radius, leaf)
            end.append(len(todo))
            leaves.append(rows if end[-1] == child[-1] else None)
            todo[k] = None
            k += 1
        size = np.array([0 if rows is None else len(rows) for rows in leaves])
        for k in reversed(range(len(leaves))):
            size[k] += size[child[k]:end[k]].sum()
        first = np.zeros(len(leaves), np.int64)
        self.order = np.empty(len(x), np.int64)
        for k, rows in enumerate(leaves):             # a node's rows are its children's, one after another
            if rows is not None:
                self.order[first[k]:first[k] + len(rows)] = rows
            own = size[child[k]:end[k]]
            first[child[k]:end[k]] = first[k] + np.cumsum(own) - own
        self.centre, self.cover = x[np.array(centre)], np.array(cover)
        self.first, self.last = first, first + size
        self.child, self.end = np.array(child), np.array(end)

    @staticmethod
    def _level(x, square, rows, radius, leaf) -> list:
        """The next level below ``rows``: nodes within the radius of their centres.  What no
        centre has enough of is one leaf (radius 0): below it, levels would be single rows."""
        kids, rest, left = [], [], rows
        while len(left):
            tried = np.unique(np.linspace(0, len(left) - 1, PIVOTS).astype(np.int64))
            at = left[tried]
            near = square[left][:, None] + square[at][None, :] - 2 * x[left] @ x[at].T <= radius * radius
            chosen: list = []
            for j in range(len(at)):
                if not near[tried[j], chosen].any():
                    chosen.append(j)
            near = near[:, chosen]
            got, which = near.any(axis=1), near.argmax(axis=1)
            many = np.bincount(which[got], minlength=len(chosen)) >= max(1, leaf // 8)
            taken = got & many[which]
            kids += [(at[chosen[i]], left[taken & (which == i)], radius / 2) for i in np.nonzero(many)[0]]
            rest.append(left[got & ~taken])
            left = left[~got]
            if taken.sum() * 16 < len(left):
                rest.append(left)
                break
        rest = np.concatenate(rest)
        if not kids or len(kids[0][1]) == len(rows) and radius < SLACK:
            return []
        return [*kids, (rest[0], rest, 0.0)] if len(rest) else kids

    def rows(self, nodes: np.ndarray) -> np.ndarray:
        """Places in ``order``."""
        return np.concatenate([np.arange(self.first[k], self.last[k]) for k in nodes])


def close(one: CoverTree, two: CoverTree, radius: float, sure: float = -1.0):
    """(node of one, nodes of two, whether all their pairs are within ``sure``): blocks that
    hold every pair within the radius once.  Node pairs go down together, level by level;
    those too far apart are dropped.  For a tree against itself (x, [x]) stands for the
    pairs inside x."""
    itself = one is two
    a = b = np.zeros(1, np.int64)
    leaf_a, leaf_b = one.child == one.end, two.child == two.end
    ends = []
    while len(a):
        gap, reach = np.linalg.norm(one.centre[a] - two.centre[b], axis=1), one.cover[a] + two.cover[b]
        whole = gap + reach <= sure
        for x, y in zip(a[whole].tolist(), b[whole].tolist()):
            yield x, [y], True
        near = (gap <= radius + reach + SLACK) & ~whole
        a, b = a[near], b[near]
        done = leaf_a[a] & leaf_b[b]
        ends.append((a[done], b[done]))
        a, b = a[~done], b[~done]
        same = itself & (a == b)
        i, j = _product(one.child[a[same]], one.end[a[same]], two.child[a[same]], two.end[a[same]])
        parts = [(i[i <= j], j[i <= j])]
        a, b = a[~same], b[~same]
        down = leaf_b[b] | ~leaf_a[a] & (one.cover[a] >= two.cover[b])
        parts.append(_product(one.child[a[down]], one.end[a[down]], b[down], b[down] + 1))
        parts.append(_product(a[~down], a[~down] + 1, two.child[b[~down]], two.end[b[~down]]))
        a, b = (np.concatenate(p) for p in zip(*parts))
    a, b = (np.concatenate(p) for p in zip(*ends)) if ends else (a, b)
    by = np.argsort(a, kind="stable")
    a, b = a[by], b[by]
    cuts = np.nonzero(np.diff(a))[0] + 1
    for x, ys in zip(a[np.r_[0, cuts]].tolist() if len(a) else (), np.split(b, cuts)):
        if itself and (ys == x).any():
            yield x, [x], False
            ys = ys[ys != x]
        if len(ys):
            yield x, ys, False


def _where(mask: np.ndarray):
    """(rows, columns) of what is set."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _product(a0, a1, b0, b1):
    """All (i, j) of the ranges [a0, a1) x [b0, b1), range pair by range pair."""
    width = b1 - b0
    n = (a1 - a0) * width
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    width = np.repeat(width, n)
    return np.repeat(a0, n) + at // np.maximum(width, 1), np.repeat(b0, n) + at % np.maximum(width, 1)


class Side:
    """The rows ``at`` of some vectors, made ready to be compared: their cover tree, and in
    its order what leaves are compared by.  By one run of coordinates only, or by all."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, parts: int, part: int | None = None):
        dim, wide = raw.shape[1], raw[at].astype(np.float64)
        with np.errstate(over="ignore"):
            norms = np.linalg.norm(wide, axis=1)
        if not (ok := np.isfinite(norms) & (norms > 0)).all():
            at, wide, norms = at[ok], wide[ok], norms[ok]
        self.edges, self.part, self.parts = part_edges(dim, parts), part, parts
        turned = wide / norms[:, None] @ rotation(dim)
        if part is None:
            own, lead = turned, turned[:, :self.edges[max(1, round(parts * LEAD))]]
        else:
            own = lead = turned[:, self.edges[part]:self.edges[part + 1]]
        if not len(at):
            self.at = at
            return
        self.tree = CoverTree(own)
        order = self.tree.order
        self.at, lead = at[order], lead[order]
        self.raw, self.norms = raw[self.at], norms[order]
        self.turned = None if part is None else turned[order]
        self.single = SINGLE * (dim + 4)
        # products of these two are squared distances, times -1/2
        square, ones = -0.5 * (lead * lead).sum(axis=1)[:, None], np.ones((len(at), 1))
        self.left, self.right = np.float32(np.hstack([lead, square, ones])), np.float32(np.hstack([lead, ones, square]))

    @functools.cached_property
    def unit(self) -> np.ndarray:
        return np.float32(self.raw / self.norms[:, None])


class Links:
    """Counts of links and sets of linked rows."""

    def __init__(self, mult: np.ndarray):
        self.mult, self.n_links, self.root = mult, np.zeros(len(mult), np.int64), np.arange(len(mult))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        n = len(self.mult)
        self.n_links += np.bincount(a, self.mult[b], n).astype(np.int64) + np.bincount(b, self.mult[a], n).astype(np.int64)
        self.unite(a, b)

    def add_block(self, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> None:
        weights = near.astype(np.float64)
        self.n_links[a] += (weights @ self.mult[b]).astype(np.int64)
        self.n_links[b] += (self.mult[a] @ weights).astype(np.int64)
        if (self.root[a] != self.root[a[0]]).any() or (self.root[b] != self.root[a[0]]).any():
            i, j = _where(near)
            self.unite(a[i], b[j])

    def add_all(self, a: np.ndarray, b: np.ndarray | None) -> None:
        """Every pair of the two sets, or of two rows of the one."""
        if b is None:
            self.n_links[a] += self.mult[a].sum() - self.mult[a]
            b = a
        else:
            self.n_links[a] += self.mult[b].sum()
            self.n_links[b] += self.mult[a].sum()
        self.unite(np.r_[a[1:], b], np.full(len(a) - 1 + len(b), a[0]))

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while (apart := root[a] != root[b]).any():    # larger roots go below smaller ones until none differ
            a, b = a[apart], b[apart]
            x, y = root[a], root[b]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while ((up := root[root]) != root).any():
                root[:] = up


def meet(one: Side, two: Side, found: Links, cosine: float, shift: int = 0) -> None:
    """Link the rows of two sets, or of one with itself.  Rows of ``two`` count from ``shift``."""
    if not len(one.at) or not len(two.at):
        return
    itself, part = one is two, one.part
    limit = (2 - 2 * cosine) / (1 if part is None else one.parts) * (1 + 1e-6) + SLACK
    sure = math.sqrt(max(0.0, 2 - 2 * cosine)) - SURE if part is None else -1.0
    least = -0.5 * (limit + one.single)
    room = np.empty(BLOCK_PAIRS, np.float32)
    held, waiting = [], 0

    def linked(i, j):
        """Of these pairs, those that count."""
        a, b = one.raw[i].astype(np.float64), two.raw[j].astype(np.float64)
        keep = np.einsum("ij,ij->i", a, b) / (one.norms[i] * two.norms[j]) >= cosine
        if part is not None:                          # a pair counts in the first run it is close in
            by_part = np.add.reduceat((one.turned[i] - two.turned[j]) ** 2, one.edges[:-1], axis=1) <= limit
            keep &= by_part[:, part] & ~by_part[:, :part].any(axis=1)
        return keep

    def flush():
        if not held:
            return
        i, j = (np.concatenate(p) for p in zip(*held))
        held.clear()
        for k in range(0, len(i), 32768):
            a, b = i[k:k + 32768], j[k:k + 32768]
            keep = linked(a, b)
            if keep.any():
                found.add(one.at[a[keep]], two.at[b[keep]] + shift)

    def crowded(start, stop, q, same):
        """Where many pairs are candidates: all products at once, those near the bound again."""
        i, off = np.arange(start, stop), one.single
        c = one.unit[start:stop] @ two.unit[q].T
        near = c >= cosine + off
        u, v = _where((c >= cosine - off) != near)
        for k in range(0, len(u), 32768):
            a, b = u[k:k + 32768], v[k:k + 32768]
            near[a, b] = linked(i[a], q[b])
        if same:
            near &= i[:, None] < q
        found.add_block(one.at[i], two.at[q] + shift, near)

    for x, ys, whole in close(one.tree, two.tree, math.sqrt(limit), sure):
        p0, p1 = int(one.tree.first[x]), int(one.tree.last[x])
        q, same = two.tree.rows(ys), itself and ys[0] == x
        if whole:
            found.add_all(one.at[p0:p1], None if same else two.at[q] + shift)
            continue
        width = BLOCK_PAIRS // min(BLOCK_ROWS, p1 - p0)
        for k in range(0, len(q), width):
            block = q[k:k + width]
            right = two.right[block].T
            for start in range(p0, min(p1, int(block[-1])) if same else p1, BLOCK_ROWS):
                stop = min(start + BLOCK_ROWS, p1)
                s = room[:(stop - start) * len(block)].reshape(stop - start, len(block))
                np.matmul(one.left[start:stop], right, out=s)
                if s.max() < least:
                    continue
                near = s >= least
                if part is None and np.count_nonzero(near) * 16 > s.size >= 4096:
                    crowded(start, stop, block, same)
                    continue
                i, j = _where(near)
                i, j = i + start, block[j]
                held.append((i[i < j], j[i < j]) if same else (i, j))
                waiting += len(i)
                if waiting >= 32768:
                    flush()
                    waiting = 0
    flush()


def link_cell(raw: np.ndarray, part: int | None, parts: int, home: np.ndarray, chunk: np.ndarray, crossed: bool,
              mult: np.ndarray, cosine: float):
    """(links per row, root row per row) of one cell: pairs with a row at home in it,
    and if ``crossed`` only those of two chunks.  With a part, pairs that are close in
    this run of coordinates and in none before."""
    found = Links(mult)
    side = lambda mask: Side(raw, np.nonzero(mask)[0], parts, part)
    if crossed:
        first = chunk == chunk.min()
        meet(side(home & first), side(~first), found, cosine)
        meet(side(home & ~first), side(~home & first), found, cosine)
    else:
        rows = side(home)
        meet(rows, rows, found, cosine)
        meet(rows, side(~home), found, cosine)
    return found.n_links, found.root


def _valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): v null where the vector links with nothing.  Single-precision
    input stays so on its way to the tasks, which compute in double precision."""
    kind = "float" if df.schema[vector].dataType == T.ArrayType(T.FloatType(), True) else "double"
    v = F.col(vector).cast(f"array<{kind}>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    # adding zero turns -0.0 into 0.0, so that equal vectors are equal arrays
    return df.select(F.col(key).alias("vec_id"), F.when(ok, F.transform(v, lambda x: x + F.lit(0).cast(kind))).alias("v"))


@contextlib.contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]):
    """Settings of the session while some jobs run."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _centres(distinct: DataFrame, dim: int, n: int) -> np.ndarray:
    """The net the vectors are laid out along: unit rows of a sample no two of which are
    closer than NET_GAP, in the order of a cover tree over them."""
    k = max(1, min(MAX_CENTRES, round(n / CELL_ROWS)))
    rows = distinct.where(F.size("v") == dim).orderBy(F.xxhash64("v"), "node").limit(k * SAMPLE_PER_CENTRE).select("v").collect()
    with np.errstate(all="ignore"):
        x = unit_rows(np.array([r["v"] for r in rows]))
    x = x[np.isfinite(x).all(axis=1)]
    chosen, gap = [], np.full(len(x), math.inf)
    for i in range(len(x)):
        if len(chosen) < k and gap[i] > NET_GAP:
            chosen.append(i)
            gap = np.minimum(gap, np.linalg.norm(x - x[i], axis=1))
    x = x[chosen]
    return x[CoverTree(x, 8).order] if len(x) else np.zeros((1, dim))


def _route(raw: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of every row."""
    return (raw @ centres.T / np.linalg.norm(raw, axis=1)[:, None] - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)


def _by_length(b: pa.RecordBatch):
    """(dim, places, vectors) of a batch's ``v``, few at a time."""
    start = b["v"].offsets.to_numpy()
    length, flat = np.diff(start), b["v"].values.to_numpy()
    for dim in np.unique(length):
        at = np.nonzero(length == dim)[0]
        for k in range(0, len(at), 2048):
            rows = at[k:k + 2048]
            yield int(dim), rows, flat[start[rows][:, None] + np.arange(dim)]


def _kind(distinct: DataFrame) -> np.dtype:
    return np.dtype("<f4" if distinct.schema["v"].dataType.elementType == T.FloatType() else "<f8")


def _chunks(distinct: DataFrame) -> tuple[DataFrame, int]:
    """(dim, node, mult, v) per chunk, packed, and the bytes of all vectors: every vector
    is in one chunk, near ones mostly in the same."""
    spark = distinct.sparkSession
    sizes = distinct.groupBy(F.size("v").alias("dim")).count().limit(65).collect()
    if len(sizes) > 64:
        raise ValueError("more than 64 vector dimensions")
    shared = spark.sparkContext.broadcast({s["dim"]: _centres(distinct, s["dim"], s["count"]) for s in sizes})
    vectors = distinct.select("node", "mult", "v")
    kind = _kind(distinct)
    most = lambda dim: max(1, min(CHUNK_ROWS, CHUNK_BYTES // (dim * kind.itemsize)))
    n = max(1, sum(math.ceil(s["count"] / most(s["dim"])) for s in sizes))

    def place(batches):
        for b in batches:
            cell, length = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32)
            for dim, rows, raw in _by_length(b):
                with np.errstate(all="ignore"):
                    cell[rows], length[rows] = _route(raw.astype(np.float64), shared.value[dim]), dim
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(length), pa.array(cell)],
                                             names=["node", "mult", "v", "dim", "cell"])

    def pack(batches):
        held: dict = {}                               # by dimension: (node, mult, vectors)

        def packed(dim, sizes):
            node, mult, v = (np.concatenate(x) for x in zip(*held.pop(dim)))
            at = 0
            for size in sizes:
                to = at + size
                cols = {"dim": pa.array([dim], pa.int32())} | {
                    name: pa.array([x[at:to].tobytes()], pa.binary()) for name, x in (("node", node), ("mult", mult), ("v", v))}
                yield pa.RecordBatch.from_pydict(cols)
                at = to
            if at < len(node):
                held[dim] = [(node[at:], mult[at:], v[at:])]

        count = lambda dim: sum(len(x[0]) for x in held[dim])
        for b in batches:
            node, mult = b["node"].to_numpy(), b["mult"].to_numpy()
            for dim, rows, raw in _by_length(b):
                held.setdefault(dim, []).append((node[rows], mult[rows], raw.astype(kind, copy=False)))
                while dim in held and count(dim) >= 2 * most(dim):
                    yield from packed(dim, [most(dim)])
        for dim in list(held):
            m = count(dim)                            # a little more than a chunk stays one
            yield from packed(dim, [m] if m <= 1.5 * most(dim) else [m // 2, m - m // 2])

    placed = vectors.mapInArrow(place, f"node bigint, mult bigint, v {vectors.schema['v'].dataType.simpleString()}, dim int, cell int")
    dealt = placed.repartitionByRange(n, "dim", "cell", "node").sortWithinPartitions("dim", "cell", "node").coalesce(n)
    chunks = dealt.select("node", "mult", "v").mapInArrow(pack, "dim int, node binary, mult binary, v binary")
    return materialize(chunks.withColumn("chunk", F.monotonically_increasing_id()), "chunks"), sum(
        s["count"] * s["dim"] * kind.itemsize for s in sizes)


def links(distinct: DataFrame, cosine: float = COSINE, parts: int = PARTS) -> DataFrame:
    """(node, n_links, root): per vector that has links; roots join exactly the
    linked vectors of one task.  ``distinct``: (node, mult, v), no two v equal."""
    spark = distinct.sparkSession
    chunks, total = _chunks(distinct)
    kind = _kind(distinct)
    a, b = (chunks.select(*(F.col(c).alias(f"{side}_{c}") for c in ("dim", "chunk", "node", "mult", "v"))) for side in "ab")
    # read side by side, not shuffled: hence no equality in the condition
    half = F.xxhash64(F.least("a_chunk", "b_chunk"), F.greatest("a_chunk", "b_chunk")).bitwiseAND(F.lit(1)) == 0
    met = a.hint("shuffle_replicate_nl").join(
        b, F.expr("a_dim <= b_dim and a_dim >= b_dim") & (
            half & F.expr("a_chunk < b_chunk") | ~half & F.expr("a_chunk > b_chunk") | F.expr("a_chunk <= b_chunk and a_chunk >= b_chunk")))

    def work(batches):
        ready: dict = {}

        def chunk(row, side):
            k = row[f"{side}_chunk"].as_py()
            held = ready.pop(k, None)
            if held is None:
                dim = row[f"{side}_dim"].as_py()
                raw = np.frombuffer(row[f"{side}_v"].as_buffer(), kind).reshape(-1, dim).copy()
                node, mult = (np.frombuffer(row[f"{side}_{c}"].as_buffer(), np.int64).copy() for c in ("node", "mult"))
                held = (k, node, mult, Side(raw, np.arange(len(raw)), min(parts, dim)))
            ready[k] = held
            while len(ready) > READY:
                del ready[next(iter(ready))]
            return held

        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch[name][at] for name in batch.schema.names}
                one, two = chunk(row, "a"), chunk(row, "b")
                if one[0] == two[0]:
                    node, found = one[1], Links(one[2])
                    meet(one[3], one[3], found, cosine)
                else:
                    node, found = np.r_[one[1], two[1]], Links(np.r_[one[2], two[2]])
                    meet(one[3], two[3], found, cosine, len(one[1]))
                some = found.n_links > 0
                yield pa.record_batch([pa.array(node[some]), pa.array(found.n_links[some]), pa.array(node[found.root][some])],
                                      names=["node", "n_links", "root"])

    found = met.mapInArrow(work, "node bigint, n_links bigint, root bigint")
    # as many tasks as pairs of splits: splits grow once there are many
    with _settings(spark, {"spark.sql.files.maxPartitionBytes": str(max(SPLIT_BYTES, total // MAX_SPLITS)),
                           "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}):
        return materialize(found.groupBy("node", "root").agg(F.sum("n_links").alias("n_links")), "links")


def _hash(v: Column) -> Column:
    return F.xxhash64(v)


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE,
            parts: int = PARTS) -> DataFrame:
    """(vec_id, n_links, component_id) for every row."""
    # a table that is written needs no shuffle files any more
    with _settings(df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        return _cluster(_valid(df, key, vector), key, cosine, parts)


def _cluster(rows: DataFrame, key: str, cosine: float, parts: int) -> DataFrame:
    distinct = materialize(rows.where("v is not null").groupBy("v").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("mult"))
        .select("v", "least", "mult", _hash(F.col("v")).alias("h"), F.monotonically_increasing_id().alias("node")), "distinct")
    found = links(distinct, cosine, parts)
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    # rows find their vector by its hash; by its value only if two vectors share one
    by = "v" if distinct.groupBy("h").count().where("count > 1").limit(1).count() else "h"
    named = materialize(distinct.join(roots, "node", "left").join(counted, "node", "left")
                        .where("links is not null or mult > 1").select(
        F.col(by).alias("w"), "least", "mult", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "named")
    ids = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    by_vector = materialize(named.join(ids, "root").select(
        "w", (F.col("links") + F.col("mult") - 1).alias("n_links"), "component_id"), "by_vector")
    found_by = F.when(F.col("v").isNotNull(), _hash(F.col("v"))) if by == "h" else F.col("v")
    out = rows.select("vec_id", found_by.alias("u")).join(by_vector, F.col("u") == F.col("w"), "left")
    return out.select(F.col("vec_id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
