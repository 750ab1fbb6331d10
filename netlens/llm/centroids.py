"""Centroid clustering of vectors in integers, exact, with PCA-rotated filtering.

A component x becomes the integer floor(scale * x); distances, means and ties are
integer arithmetic, so every run gives the same clusters.  Lloyd's rounds: each
vector goes to its nearest centroid (ties: the smaller number), then each
non-empty centroid becomes the componentwise floor(sum / count) of its vectors.

Method: the vectors' second moments give a rotation onto their principal axes.  A
vector is stored with its ``lead`` leading rotated coordinates y and the norm r of
the rest.  For a centroid c, |y(x) - y(c)|^2 + (r(x) - r(c))^2 never exceeds
|x - c|^2 (the rest's difference is at least the difference of its norms), so it
is a lower bound from ``lead`` + 1 numbers.  The centroid of the least bound is
measured first; those whose bound exceeds that distance, by more than rounding can
explain, are filtered out, and the survivors are verified in integers.  The
rotation decides how many are filtered, never a result.

Scale: one pass stores integers and coordinates; a round is one map over them with
no shuffle of vectors: a task adds up its clusters and sends k * (dim + 1) sums,
which Spark adds before the driver reads k rows.  Driver state: k centroids and one
dim x dim matrix, whatever the number of rows.  A cluster holding most of the
vectors is only ever a sum.

Rows that do not take part (null, another number of components, a null or
non-finite component) are not returned.  A component beyond 2**27 raises, as its
squared distance might not fit a long.  Repeated vectors are vectors of their own;
a null id hashes as the empty text; rows of equal id are ordered by components when
centroids start.  Fewer rows than k: as many centroids.  An empty table gives no
rows.  Other columns are not read, whatever their names.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import materialize

K, ROUNDS, DIM, SCALE, LEAD = 16, 3, 64, 64, 16
LIMIT = 1 << 27
#: Entries of a (vectors, centroids) matrix worked on at a time.
CHUNK = 1 << 16


def quantize(df: DataFrame, key: str, vector: str, dim: int, scale: int) -> DataFrame:
    """(key, comps) of the vectors that take part."""
    v = F.col(vector)
    sound = F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: F.coalesce(
        ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))), F.lit(False))
    fits = F.forall(v, lambda x: F.abs(x.cast("double") * scale) < LIMIT)
    comps = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    too_large = F.raise_error(F.lit(f"a component times {scale} is beyond {LIMIT}")).cast("array<bigint>")
    return df.where(sound).select(F.col(key).alias("key"), F.when(fits, comps).otherwise(too_large).alias("comps"))


def _matrix(column: pa.ListArray, width: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(dtype, copy=False)


def _batches(batches, rows: int):
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def rotation(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes (columns, the widest first) of all vectors."""
    def run(batches):
        total, moments, count = np.zeros(dim), np.zeros((dim, dim)), 0
        for b in batches:
            x = _matrix(b["comps"], dim, np.float64)
            total, moments, count = total + x.sum(0), moments + x.T @ x, count + len(x)
        values = np.concatenate([[count], total, moments.ravel()])
        yield pa.record_batch([pa.array(np.arange(len(values)), pa.int32()), pa.array(values, pa.float64())], names=["i", "v"])

    sums = vectors.select("comps").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    values = np.zeros(1 + dim + dim * dim)
    for r in sums:
        values[r["i"]] = r["v"]
    count = max(values[0], 1.0)
    mean = values[1:dim + 1] / count
    _, axes = np.linalg.eigh(values[dim + 1:].reshape(dim, dim) / count - np.outer(mean, mean))
    return mean, axes[:, ::-1].copy()


def rotated(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and the norm of the rest."""
    y = (x - mean) @ axes
    return y[:, :lead], np.sqrt((y[:, lead:] ** 2).sum(1))


def store(vectors: DataFrame, mean: np.ndarray, axes: np.ndarray, lead: int) -> DataFrame:
    """(key, comps, lead, rest) of every vector, written."""
    def run(batches):
        for b in _batches(batches, 4096):
            y, rest = rotated(_matrix(b["comps"], len(mean), np.float64), mean, axes, lead)
            y = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, lead), pa.int32()), pa.array(y.ravel()))
            yield pa.record_batch([b["key"], b["comps"], y, pa.array(rest)], names=["key", "comps", "lead", "rest"])

    kind = vectors.schema["key"].dataType.simpleString()
    out = vectors.mapInArrow(run, f"key {kind}, comps array<bigint>, lead array<double>, rest double")
    return materialize(out, "rotated")


def nearest(x: np.ndarray, y: np.ndarray, rest: np.ndarray, c: np.ndarray, cy: np.ndarray,
            c_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid, and how many
    pairs were verified.  x, c: integers; y, cy: leading coordinates; rest, c_rest: norms."""
    rows = np.arange(len(x))
    bound = ((y[:, None, :] - cy[None]) ** 2).sum(2) + (rest[:, None] - c_rest[None]) ** 2
    size = (y ** 2).sum(1) + rest ** 2
    slack = 1e-9 * (size[:, None] + ((cy ** 2).sum(1) + c_rest ** 2)[None]) + 1e-6
    first = bound.argmin(1)
    best = ((x - c[first]) ** 2).sum(1)
    open_ = bound - slack <= best[:, None]
    open_[rows, first] = False
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    exact[rows, first] = best
    i, j = np.nonzero(open_)
    for k in range(0, len(i), CHUNK):
        a, b = i[k:k + CHUNK], j[k:k + CHUNK]
        exact[a, b] = ((x[a] - c[b]) ** 2).sum(1)
    cluster = exact.argmin(1)
    return cluster, exact[rows, cluster], len(x) + len(i)


class _Assigner:
    """The nearest centroids of Arrow batches of stored vectors."""

    def __init__(self, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray, lead: int):
        self.c, self.lead = centroids, lead
        self.cy, self.c_rest = rotated(centroids.astype(np.float64), mean, axes, lead)

    def __call__(self, batches):
        for b in _batches(batches, max(1, CHUNK // len(self.c))):
            x = _matrix(b["comps"], self.c.shape[1], np.int64)
            y = _matrix(b["lead"], self.lead, np.float64)
            cluster, distance, verified = nearest(x, y, b["rest"].to_numpy(), self.c, self.cy, self.c_rest)
            yield b, x, cluster, distance, verified


def _sums(stored: DataFrame, assign: _Assigner) -> list:
    """Each cluster's count (place 0) and component sums, as exact integers."""
    k, dim = assign.c.shape

    def run(batches):
        total = np.zeros((k, dim + 1), np.int64)
        for _, x, cluster, _, _ in assign(batches):
            total[:, 0] += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            found, starts = np.unique(cluster[order], return_index=True)
            total[found, 1:] += np.add.reduceat(x[order], starts)
        i, j = np.nonzero(total)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["cluster", "place", "s"])

    return (stored.select("comps", "lead", "rest").mapInArrow(run, "cluster int, place int, s long")
            .groupBy("cluster", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())


def _moved(centroids: np.ndarray, sums: list) -> np.ndarray:
    total = {(r["cluster"], r["place"]): int(r["s"]) for r in sums}
    out = centroids.copy()
    for c in range(len(out)):
        if count := total.get((c, 0)):
            out[c] = [total.get((c, d), 0) // count for d in range(1, out.shape[1] + 1)]
    return out


def start(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of the smallest sha256 of ``<seed>:<key>``, in that order."""
    ticket = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    rows = vectors.select(ticket.alias("ticket"), "comps").orderBy("ticket", "comps").limit(k).collect()
    return np.array([r["comps"] for r in rows], np.int64)


def _sha(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS,
            dim: int = DIM, scale: int = SCALE, lead: int = LEAD, seed: str = "1") -> tuple[DataFrame, np.ndarray]:
    """One row per vector that takes part: key, cluster, distance, cluster_inertia,
    inertia, centroid_sha256; and the final centroids (a row each)."""
    lead = min(lead, dim)
    vectors = materialize(quantize(df, key, vector, dim, scale), "quantized")
    centroids = start(vectors, k, seed)
    kind = vectors.schema["key"].dataType.simpleString()
    if not len(centroids):
        empty = df.sparkSession.createDataFrame(
            [], f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        return empty, centroids
    mean, axes = rotation(vectors, dim)
    stored = store(vectors, mean, axes, lead)
    for _ in range(rounds):
        centroids = _moved(centroids, _sums(stored, _Assigner(centroids, mean, axes, lead)))
    assign = _Assigner(centroids, mean, axes, lead)

    def run(batches):
        for b, _, cluster, distance, _ in assign(batches):
            yield pa.record_batch([b["key"], pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                                  names=["key", "cluster", "distance"])

    final = materialize(stored.mapInArrow(run, f"key {kind}, cluster int, distance long"), "assigned")
    spent = {r["cluster"]: int(r["s"]) for r in final.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def of(values: dict, kind: str) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for c, v in values.items() for x in (c, v)]), F.col("cluster")).cast(kind)

    return final.select(
        F.col("key").alias(key), "cluster", "distance", of(spent, "long").alias("cluster_inertia"),
        F.lit(sum(spent.values())).cast("long").alias("inertia"),
        of({c: _sha(centroids[c]) for c in spent}, "string").alias("centroid_sha256")), centroids
