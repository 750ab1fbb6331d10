"""Benign gate: an isolation forest grown and applied on Spark.

Algorithm (Liu, Ting, Zhou 2008): every tree sees a sample of at most
``psi`` = 256 rows and grows to height ceil(log2 psi) by splitting a random
non-constant feature at a uniform point between its sample min and max.  A
row's score is 2^(-E[h(x)] / c(psi)); the gate flags rows whose score is
above the (1 - contamination) quantile of the training scores.

Spark shape:
* sampling: every row draws once per tree (xxhash64 of key and tree); about
  4*psi candidates per tree pass a threshold on the draw, then the psi
  smallest draws are taken inside the tree's group;
* growing: ``groupBy("tree").applyInPandas`` - each group holds about
  4*psi rows, so the work per task is bounded whatever the table size;
* the node table (trees x at most 2^(h+1) nodes) is small and bounded by
  the parameters, so it goes with an Arrow UDF that scores batches, all
  trees at once, on the flat feature buffer;
* the threshold is the exact quantile of the training scores, found by radix
  selection (:mod:`netlens.operators.quantiles`: four aggregates, no sort).
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.functions.columns import signed_log
from netlens.operators.prune import scale_stats
from netlens.operators.quantiles import exact_quantiles
from netlens.schema import RANDOM_SEED
from netlens.session import cut_lineage

EULER = 0.5772156649015329
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size int, depth int")


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int, tree: int) -> list[tuple]:
    nodes: list[list] = []

    def build(idx: np.ndarray, depth: int) -> int:
        nid = len(nodes)
        nodes.append([tree, nid, -1, 0.0, -1, -1, int(len(idx)), depth])
        if depth >= limit or len(idx) <= 1:
            return nid
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        varying = np.flatnonzero(hi > lo)
        if len(varying) == 0:
            return nid
        q = int(rng.choice(varying))
        p = float(rng.uniform(lo[q], hi[q]))
        left = idx[sub[:, q] < p]
        right = idx[sub[:, q] >= p]
        nodes[nid][2], nodes[nid][3] = q, p
        nodes[nid][4] = build(left, depth + 1)
        nodes[nid][5] = build(right, depth + 1)
        return nid

    build(np.arange(len(x)), 0)
    return [tuple(n) for n in nodes]


@dataclass
class Gate:
    features: list[str]
    scale: dict               # feature -> (mean, std) after the signed log (k entries)
    nodes: pd.DataFrame       # node table (bounded by trees x nodes)
    psi: int
    threshold: float
    log: bool = True
    trees: int = 50
    contamination: float = 0.05

    def scaled(self) -> list[Column]:
        out = []
        for c in self.features:
            m, s = self.scale[c]
            x = signed_log(c) if self.log else F.col(c).cast("double")
            out.append((x - F.lit(m)) / F.lit(s))
        return out

    def score_column(self) -> Column:
        """Anomaly score of the raw feature columns (scaling applied inside)."""
        return _score_udf(self.nodes, self.psi, len(self.features))(F.array(*self.scaled()))


def _score_udf(nodes: pd.DataFrame, psi: int, k: int):
    """Arrow UDF over feature arrays: all trees of a batch walk down together.

    The trees lie in one node table.  A leaf is its own child, so a walk needs no
    test for its end: after as many steps as the tallest tree has levels, every
    walk stands on its leaf.
    """
    n = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    base = n.groupby("tree").cumcount()
    first = n.index.to_numpy() - base.to_numpy()              # where the row's tree begins
    inner = (n["feature"] >= 0).to_numpy()
    own = np.arange(len(n))
    feat = np.where(inner, n["feature"], 0).astype(np.int64)
    thr = n["threshold"].to_numpy()
    child = np.stack([np.where(inner, first + n["left"], own), np.where(inner, first + n["right"], own)], axis=1).ravel()
    # path length credited where a row ends: depth + c(size)
    path = n["depth"].to_numpy() + np.array([c_factor(s) for s in n["size"].to_numpy()])
    roots = np.unique(first)
    height, cpsi = int(n["depth"].max()), c_factor(psi)

    @F.arrow_udf(T.DoubleType())
    def score(vals: pa.Array) -> pa.Array:
        x = vals.flatten().to_numpy(zero_copy_only=False)
        out = np.empty(len(vals))
        for at in range(0, len(vals), 1024):                  # rows x trees stays in the cache
            rows = np.arange(at, min(at + 1024, len(vals)))
            node = np.broadcast_to(roots, (len(rows), len(roots)))
            for _ in range(height):
                right = ~(x[rows[:, None] * k + feat[node]] < thr[node])
                node = child[2 * node + right]
            out[rows] = np.power(2.0, -path[node].mean(axis=1) / cpsi)
        return pa.array(out)

    return score


def fit_gate(benign: DataFrame, features: list[str], key: str, trees: int = 50,
             psi: int = 256, contamination: float = 0.05, seed: int = RANDOM_SEED,
             log: bool = True) -> Gate:
    """Fit the gate on benign rows (M6): signed log -> scale -> isolation forest,
    threshold = (1 - contamination) quantile of the training scores (A32)."""
    benign = cut_lineage(benign.select(key, *features))      # several passes follow
    scale = {r["feature"]: (r["mean"], r["std"])
             for r in scale_stats(benign, features, log=log).collect()}   # k rows
    gate = Gate(list(features), scale, pd.DataFrame(), psi, 0.0, log, trees, contamination)
    scaled = benign.select(F.col(key), *[x.alias(c) for x, c in zip(gate.scaled(), features)])
    n = scaled.count()
    # every tree draws its own candidates: about 4 * psi of them, or all rows of
    # a table smaller than that
    cut = int(min(1.0, 4 * psi / max(n, 1)) * (1 << 62))
    draws = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(trees - 1)),
                    lambda t: F.struct(t.alias("tree"),
                                       F.abs(F.xxhash64(F.col(key), t, F.lit(seed)) % (1 << 62))
                                        .alias("draw"))),
        lambda s_: s_["draw"] < F.lit(cut))
    cand = scaled.select(*features, F.explode(draws).alias("_d")).select(
        F.col("_d.tree").alias("tree"), F.col("_d.draw").alias("draw"), *features)
    limit = int(math.ceil(math.log2(max(psi, 2))))
    feats = list(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.nsmallest(psi, "draw")
        rng = np.random.default_rng(seed * 100_003 + t)
        rows = _grow(pdf[feats].to_numpy(dtype="float64"), rng, limit, t)
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left",
                                           "right", "size", "depth"])

    gate.nodes = cand.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    train_scores = benign.select(gate.score_column().alias("score"))
    gate.threshold = exact_quantiles(train_scores, "score", [1.0 - contamination])[0]
    return gate


def score_gate(df: DataFrame, gate: Gate) -> DataFrame:
    """Anomaly score and flag for every row (gate step of M8); columns kept."""
    return df.withColumn("anomaly_score", gate.score_column()) \
             .withColumn("is_anomaly", F.col("anomaly_score") > F.lit(gate.threshold))


def recalibrate(gate: Gate, benign: DataFrame, key: str, **kw) -> Gate:
    """Refit the gate on one network's benign rows, with its own parameters (M7)."""
    own = {"psi": gate.psi, "log": gate.log, "trees": gate.trees, "contamination": gate.contamination}
    return fit_gate(benign, gate.features, key, **{**own, **kw})


def save_gate(gate: Gate, spark, path: str) -> None:
    """Persist the gate (scale, nodes, threshold) as parquet tables under ``path``."""
    spark.createDataFrame([(c, float(m), float(sd)) for c, (m, sd) in gate.scale.items()],
                          "feature string, mean double, std double") \
        .write.mode("overwrite").parquet(f"{path}/scale")
    spark.createDataFrame(gate.nodes).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(gate.threshold, gate.psi, gate.log, gate.trees, gate.contamination,
                            list(gate.features))],
                          "threshold double, psi int, log boolean, trees int, "
                          "contamination double, features array<string>") \
        .write.mode("overwrite").parquet(f"{path}/meta")


def load_gate(spark, path: str) -> Gate:
    meta = spark.read.parquet(f"{path}/meta").first()
    scale = {r["feature"]: (r["mean"], r["std"])
             for r in spark.read.parquet(f"{path}/scale").collect()}
    return Gate(list(meta["features"]), scale,
                spark.read.parquet(f"{path}/nodes").toPandas(), int(meta["psi"]),
                float(meta["threshold"]), bool(meta["log"]), int(meta["trees"]),
                float(meta["contamination"]))
