"""Language identification with hyperdimensional profiles.

Every letter (and the word edge) owns a random vector of +1/-1.  An n-gram's
vector binds its letters' vectors by element-wise product after rotating each by
its place in the n-gram; a text's vector is the bundle (sum) of its n-grams'
vectors.  A language's prototype is the bundle of all its training texts, and a
text gets the language whose prototype has the largest cosine with it.

Letter vectors are drawn from the code point alone, so workers agree on them
without sharing anything.  Prototypes are summed as exact integers (per
partition, then by (language, dimension) in Spark), so the result depends on
neither order nor partitioning.  Only prototypes reach the driver: DIM numbers a
language, ``MAX_LANGS`` languages at most (beyond that ``train`` raises).

Text null or without a letter: ``und``, score 0.  No training text at all: the
same.  Equal cosines: the smallest language.  Texts are read whole.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import slices

DIM = 1024
MAX_LANGS = 8192
SEED = 7_2021
#: Languages a worker sums at once before it hands its sums on.
FLUSH_LANGS = 512


class Letters:
    """Random vectors of the letters met so far, rotated for each of three places."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.row = np.full(0x110000, -1, np.int32)
        self.row[0] = 0                               # the word edge
        self.places = [np.empty((64, dim), np.int8) for _ in range(3)]
        self.n = 0
        self._add([0])

    def _add(self, points) -> None:
        while self.n + len(points) > len(self.places[0]):
            self.places = [np.concatenate([m, np.empty_like(m)]) for m in self.places]
        for c in points:
            v = np.random.Generator(np.random.Philox(key=SEED + int(c))).integers(0, 2, self.dim, np.int8) * 2 - 1
            for shift, m in enumerate(self.places):
                m[self.n] = np.roll(v, 2 - shift)
            self.row[c] = self.n
            self.n += 1

    def grams(self, text: str) -> np.ndarray:
        """Trigram codes of a text (letters' rows, 21 bits each), repeats included."""
        c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        c = np.where(self.letter[c], c, 0)
        if not c.any():
            return np.empty(0, np.int64)
        c = np.concatenate([[0], c, [0]])
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)       # one edge between words
        c = c[keep]
        r = self.row[c].astype(np.int64)
        if (r < 0).any():
            self._add(np.unique(c[r < 0]))
            r = self.row[c].astype(np.int64)
        g = r[:-2] << 42 | r[1:-1] << 21 | r[2:]
        return g[r[1:-1] != 0]

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dim, np.float64)
        mask = (1 << 21) - 1
        for k in range(0, len(grams), 4096):
            g = grams[k:k + 4096]
            bound = self.places[0][g >> 42] * self.places[1][g >> 21 & mask] * self.places[2][g & mask]
            out += counts[k:k + 4096].astype(np.float32) @ bound.astype(np.float32)
        return out


@lru_cache(maxsize=1)
def letters() -> Letters:
    return Letters()


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from rows with a language."""
    src = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")

    def run(batches):
        hd, sums = letters(), {}

        def flushed():
            names = list(sums)
            yield pa.record_batch([pa.array(names, pa.string()),
                                   pa.array([sums[n] for n in names], pa.list_(pa.int64()))],
                                  names=["lang", "v"])
            sums.clear()

        for b in slices(batches):
            by: dict[str, list] = {}
            for t, name in zip(b["text"].to_pylist(), b["lang"].to_pylist()):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                # counts of up to 64 texts are added up before their n-grams are bound
                for k in range(0, len(texts), 64):
                    grams, counts = np.unique(np.concatenate([hd.grams(t) for t in texts[k:k + 64]]),
                                              return_counts=True)
                    v = np.rint(hd.bundle(grams, counts)).astype(np.int64)
                    sums[name] = sums[name] + v if name in sums else v
            if len(sums) >= FLUSH_LANGS:
                yield from flushed()
        if sums:
            yield from flushed()

    parts = src.mapInArrow(run, "lang string, v array<bigint>")
    sums = (parts.select("lang", F.posexplode("v").alias("i", "x"))
                 .groupBy("lang", "i").agg(F.sum("x").alias("x")))
    rows = (sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
                .select("lang", "v.x").limit(MAX_LANGS + 1).collect())
    if len(rows) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")
    rows = sorted((r for r in rows if any(r["x"])), key=lambda r: r["lang"])
    protos = np.array([r["x"] for r in rows], np.float64).reshape(len(rows), DIM)
    return [r["lang"] for r in rows], protos


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row."""
    names, protos = model
    norms = np.linalg.norm(protos, axis=1, keepdims=True)
    shared = df.sparkSession.sparkContext.broadcast((names, (protos / np.where(norms == 0, 1, norms)).astype(np.float32)))
    src = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = src.schema["key"].dataType.simpleString()

    def one(hd, t):
        langs, unit = shared.value
        g = hd.grams(t) if t else ()
        if not len(g) or not langs:
            return "und", 0.0
        v = hd.bundle(*np.unique(g, return_counts=True))
        cos = unit @ (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)
        k = int(np.argmax(cos))
        return langs[k], float(min(1.0, max(0.0, cos[k])))

    def run(batches):
        hd = letters()
        for b in slices(batches):
            got = [one(hd, t) for t in b["text"].to_pylist()]
            yield pa.record_batch([b["key"], pa.array([x[0] for x in got], pa.string()),
                                   pa.array([x[1] for x in got], pa.float64())],
                                  names=["key", "lang_pred", "score"])

    return src.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
