"""Vector pairs by chunks: what is shipped and written, dense sets, clashing hashes."""
import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlens.llm import covertree
from tests.llm.test_pairs_and_archives import brute_vectors, sets_of, vectors

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SHIPPED = """
import sys, numpy as np
from netlens.llm import covertree
from pyspark.sql import SparkSession
log, n = sys.argv[1], int(sys.argv[2])
spark = SparkSession.builder.master("local[2]").config(map={
    "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "4",
    "spark.checkpoint.dir": log + "/kept", "spark.local.dir": log + "/local", "spark.eventLog.enabled": "true",
    "spark.eventLog.dir": "file://" + log, "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"}).getOrCreate()
covertree.CELL_ROWS, covertree.CHUNK_ROWS = 16, 256
x = np.random.default_rng(4).standard_normal((n, 64)).astype(np.float32)
df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
df.write.parquet(log + "/in")
print(covertree.cluster(spark.read.parquet(log + "/in")).where("n_links = 0 and component_id = vec_id").count())
spark.stop()
"""


def test_vectors_are_shipped_twice_at_most(tmp_path):
    """Shuffle of the whole job, many cells and chunks: once to find equal vectors, once to lay them out."""
    n = 4000
    env = os.environ | {"PYTHONPATH": REPO, "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", SHIPPED, str(tmp_path), str(n)], env=env, cwd=REPO, capture_output=True, text=True, timeout=600)
    assert done.stdout.split()[-1:] == [str(n)], done.stderr[-2000:]
    shipped = 0
    for p in tmp_path.glob("*local-*"):
        for line in p.open():
            e = json.loads(line)
            if e["Event"] == "SparkListenerTaskEnd":
                shipped += (e.get("Task Metrics") or {}).get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
    assert n * 256 < shipped < 3.5 * n * 256
    written = sum(p.stat().st_size for p in (tmp_path / "kept").rglob("*.parquet"))
    assert written < 3.5 * n * 256
    left = sum(p.stat().st_size for p in (tmp_path / "local").rglob("shuffle_*"))
    assert left < 0.5 * n * 256


@pytest.mark.parametrize("leaf,crossed", [(16, False), (64, True), (512, False), (512, True)])
def test_dense_sets_equal_brute_force(monkeypatch, leaf, crossed):
    """Nodes taken as a whole, crowded blocks and lone rows in one cell, counted with multiplicity."""
    monkeypatch.setattr(covertree, "LEAF_ROWS", leaf)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 64))
    raw = np.concatenate([rng.standard_normal((400, 64))] + [
        c + noise * rng.standard_normal((m, 64)) for c, noise, m in zip(
            centres, (0, 1e-9, 0.02, 0.05, 0.1, 0.2, 0.22, 0.24), (100, 100, 300, 300, 300, 300, 300, 300))])
    raw *= rng.uniform(0.1, 10, (len(raw), 1))
    raw = rng.permutation(raw)
    chunk, mult = rng.integers(0, 2, len(raw)), rng.integers(1, 4, len(raw))
    n, root = covertree.link_cell(np.float32(raw), None, 8, np.ones(len(raw), bool), chunk, crossed, mult, 0.95)
    unit = covertree.unit_rows(np.float32(raw).astype(float))
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    if crossed:
        near &= chunk[:, None] != chunk[None, :]
    assert (n == near @ mult).all()
    rows = range(len(raw))
    assert sets_of(rows, enumerate(root.tolist())) == sets_of(rows, [(int(i), int(j)) for i, j in zip(*np.nonzero(near))])


def test_tree_nodes_cover_their_rows(monkeypatch):
    monkeypatch.setattr(covertree, "LEAF_ROWS", 16)
    x = np.array(vectors(9))
    tree = covertree.CoverTree(covertree.unit_rows(x))
    assert sorted(tree.order.tolist()) == list(range(len(x))) and len(tree.child) > 5
    for k in range(len(tree.child)):
        rows = covertree.unit_rows(x)[tree.order[tree.first[k]:tree.last[k]]]
        assert np.linalg.norm(rows - tree.centre[k], axis=1).max() <= tree.cover[k] + 1e-12
        kids = range(tree.child[k], tree.end[k])
        assert not len(kids) or sum(tree.last[j] - tree.first[j] for j in kids) == tree.last[k] - tree.first[k]


def test_every_vector_is_in_one_chunk(spark, monkeypatch):
    monkeypatch.setattr(covertree, "CHUNK_ROWS", 40)
    rows = [(i, 1 + i % 3, [float(x) for x in np.random.default_rng(i).standard_normal(3 if i % 5 == 0 else 64)]) for i in range(500)]
    chunks, total = covertree._chunks(spark.createDataFrame(rows, "node long, mult long, v array<double>").repartition(3))
    got = {}
    for r in chunks.collect():
        node, mult = (np.frombuffer(r[c], np.int64).tolist() for c in ("node", "mult"))
        assert len(node) <= 80
        for i, m, v in zip(node, mult, np.frombuffer(r["v"], "<f8").reshape(len(node), r["dim"]).tolist()):
            assert i not in got
            got[i] = (i, m, v)
    assert [got[i] for i in range(500)] == rows and total == 8 * (400 * 64 + 100 * 3)


def test_hashes_that_clash(spark, monkeypatch):
    """Rows find their vector by its value where two vectors share a hash."""
    rows = list(enumerate([*vectors(6)[:90], *vectors(6)[:30], None, [0.0] * 64]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(covertree, "_hash", lambda v: F.size(v).cast("long"))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in covertree.cluster(df).collect()} == brute_vectors(rows)
