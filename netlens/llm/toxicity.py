"""Toxicity by class-conditional Kneser-Ney models.

An expression is a word; its likelihood under a class is that of its letters,
each given up to ``ORDER - 1`` letters before it (word edges count as letters).
A class model discounts its own n-gram counts and backs off to counts both
classes share: how many different letters were seen before each shorter n-gram
(Kneser-Ney continuation counts).  An n-gram that neither class has seen costs
both classes the same shared probability, so only the classes' backoff weights
differ: rare words say little.

A text's features are its words' log-likelihood ratios, length-normalised: the
mean over the whole text and over its ``TOP`` most telling words, with the
logarithm of the number of words.  A logistic curve, fitted on labelled rows that
the counts have not seen, turns them into a score.  At most ``MAX_FIT_ROWS`` rows a
class fit it (chosen by hash), each weighted by the inverse of its class's sampling
rate, so the share of the classes stays that of all labelled rows.

All labelled rows outside the fit are counted, every n-gram included.  The counts
are combined per partition and shuffled by word, then by n-gram; the n-grams stay a
distributed table, and the backoff joins each length to the one below.  To score,
the distinct words are dealt into shards by hash; a shard asks the table once for
each of its n-grams, so a common n-gram has at most one row a shard.  Ratios of the
commonest words (at most ``COMMON_WORDS``) are broadcast, those of other words are
joined to the documents they stand in.

Empty and null texts have all features 0.  Without labelled rows of both classes
every score is the share of label 1 (0 without any).  Null labels are ignored; a
document labelled twice takes the larger label.
"""
from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import materialize, slices

ORDER = 5
DISCOUNT = 0.75
TOP = (1, 3, 5)
MAX_FIT_ROWS = 20_000         # labelled rows a class that fit the logistic curve
MAX_WORD = 64                 # longer words are scored in pieces of this length
COMMON_WORDS = 1 << 17        # words whose ratios are broadcast
SHARD_WORDS = 1 << 15         # words a shard is meant to hold
MIN_SHARDS = 24
RIDGE = 0.05
FEATURES = ("mean", *(f"top{k}" for k in TOP), "length")

# hashes of letter runs: a polynomial in the code points, mixed with the length
_P = 0x100000001B3
_SALT = 0x9E3779B97F4A7C15
_MIX = 0xD6E8FEB86659FD93
OPEN, CLOSE = "\x02", "\x03"  # word edges

_WORDS = re.compile(r"\w+")


def words(text: str) -> list[str]:
    found = _WORDS.findall(text.lower())
    if any(len(w) > MAX_WORD for w in found):
        found = [w[k:k + MAX_WORD] for w in found for k in range(0, len(w), MAX_WORD)]
    return found


def grams(word: str):
    """Every letter of the word with the letters before it."""
    s = OPEN + word + CLOSE
    for i in range(1, len(s)):
        yield s[max(0, i - ORDER + 1):i + 1]


def _suffix_hashes(points: np.ndarray) -> list[np.ndarray]:
    """For every place, hashes of the 0, 1, ... ORDER letters that end there."""
    sums, out = np.zeros(len(points), np.uint64), [np.zeros(len(points), np.uint64)]
    for k in range(ORDER):
        shifted = np.zeros(len(points), np.uint64)
        shifted[k:] = points[:max(0, len(points) - k)]
        sums = sums + (shifted + np.uint64(1)) * np.uint64(pow(_P, k, 1 << 64))
        h = sums + np.uint64((k + 1) * _SALT % (1 << 64))
        h = (h ^ h >> np.uint64(31)) * np.uint64(_MIX)
        out.append(h ^ h >> np.uint64(29))
    return out


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts on end, and where each ends."""
    return (np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64),
            np.cumsum([len(t) for t in texts]))


def _sum_by(keys: np.ndarray, *columns: np.ndarray):
    """(distinct keys in order, sums of each column, place of each input key)."""
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, [np.bincount(place, weights=c, minlength=len(distinct)) for c in columns], place


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys in a sorted table, -1 where absent."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


@dataclass
class Ratios:
    """What scoring needs, by hash: log(p1/p0) of the n-grams seen, and of each
    context's backoff weight."""
    seen: np.ndarray
    seen_ratio: np.ndarray
    context: np.ndarray
    context_ratio: np.ndarray

    def words(self, found: list[str]) -> np.ndarray:
        """The log-likelihood ratio of each word."""
        points, ends = _points([OPEN + w + CLOSE for w in found])
        starts = np.append(0, ends[:-1])
        word = np.repeat(np.arange(len(found)), ends - starts)
        size = np.minimum(np.arange(len(points)) - starts[word] + 1, ORDER)
        h = np.stack(_suffix_hashes(points))
        at = np.nonzero(size > 1)[0]                  # every letter but the opening edge
        gram, before = h[size[at], at], h[size[at] - 1, at - 1]
        i, j = _find(self.seen, gram), _find(self.context, before)
        r = np.where(i >= 0, self.seen_ratio[i], np.where(j >= 0, self.context_ratio[j], 0.0))
        return np.bincount(word[at], weights=r, minlength=len(found))


def _ends(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the n-grams; hashes of their last 0 ... ORDER letters, and of those
    before the last letter (one row a number of letters)."""
    size, last, before = [], [], []
    for k in range(0, len(texts), 1 << 16):           # a piece at a time bounds the memory
        points, ends = _points(texts[k:k + (1 << 16)])
        h = np.stack(_suffix_hashes(points))
        size.append(np.diff(np.append(0, ends)))
        last.append(h[:, ends - 1])
        before.append(h[:, np.maximum(ends - 2, 0)])
    return np.concatenate(size), np.concatenate(last, axis=1), np.concatenate(before, axis=1)


def build(texts: list[str], n0: np.ndarray, n1: np.ndarray) -> Ratios:
    """Kneser-Ney from the n-grams and their counts in the two classes, in memory:
    what ``gram_ratios`` must equal."""
    size, last, before = _ends(texts)
    # shared continuation counts, from distinct longer n-grams to shorter ones
    tables = {}
    for k in range(ORDER, 1, -1):
        rows = np.nonzero(size >= k)[0]
        if not len(rows):
            continue
        rows = rows[np.unique(last[k][rows], return_index=True)[1]]
        short, (n,), place = _sum_by(last[k - 1][rows], np.ones(len(rows)))
        where = np.zeros(len(short), np.int64)
        where[place] = rows                           # an n-gram that ends in each shorter one
        _, (total, kinds), of = _sum_by(before[k - 2][where], n, np.ones(len(n)))
        tables[k - 1] = short, n, total[of], kinds[of], where
    floor = 1.0 / (len(tables[1][0]) + 1)
    shared: dict[int, tuple] = {}

    def backoff(k: int, rows: np.ndarray) -> np.ndarray:
        return shared[k][1][_find(shared[k][0], last[k][rows])]

    for k in sorted(tables):
        keys, n, total, kinds, where = tables[k]
        q = floor if k == 1 else backoff(k - 1, where)
        shared[k] = keys, (n - DISCOUNT + DISCOUNT * kinds * q) / total
    own, context, q = (np.zeros(len(texts), t) for t in (np.uint64, np.uint64, np.float64))
    for k in range(2, ORDER + 1):
        rows = np.nonzero(size == k)[0]
        if len(rows):
            own[rows], context[rows], q[rows] = last[k][rows], before[k - 1][rows], backoff(k - 1, rows)
    names, sums, of = _sum_by(context, n0, n1, n0 > 0, n1 > 0)
    weight, prob = [], []
    for n, total, kinds in ((n0, sums[0], sums[2]), (n1, sums[1], sums[3])):
        some = np.maximum(total, 1)
        w = np.where(total > 0, DISCOUNT * kinds / some, 1.0)
        weight.append(w)
        prob.append(np.where(total[of] > 0, np.maximum(n - DISCOUNT, 0) / some[of], 0.0) + w[of] * q)
    by = np.argsort(own)
    return Ratios(own[by], np.log(prob[1] / prob[0])[by].astype(np.float32), names,
                  np.log(weight[1] / weight[0]).astype(np.float32))


def _class_words(rows: DataFrame) -> DataFrame:
    """(word, n0, n1) over labelled (text, label) rows."""
    def run(batches):
        found: list[Counter] = [Counter(), Counter()]
        for b in slices(batches):
            for t, y in zip(b["text"].to_pylist(), b["label"].to_pylist()):
                found[y].update(words(t or ""))
            if sum(map(len, found)) > 1 << 19:
                yield _table(found)
                found = [Counter(), Counter()]
        yield _table(found)

    return (rows.select("text", "label").mapInArrow(run, "item string, n0 bigint, n1 bigint")
                .groupBy("item").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def _table(found: list[Counter]):
    items = list(found[0].keys() | found[1].keys())
    return pa.record_batch([pa.array(items, pa.string()), *(pa.array([c[i] for i in items], pa.int64()) for c in found)],
                           names=["item", "n0", "n1"])


def _word_hashes(found: list[str]):
    """(hashes, word of each letter, letters up to each in its word) of words with their edges."""
    points, ends = _points([OPEN + w + CLOSE for w in found])
    starts = np.append(0, ends[:-1])
    word = np.repeat(np.arange(len(found)), ends - starts)
    return np.stack(_suffix_hashes(points)), word, np.arange(len(points)) - starts[word] + 1


_STRINGS = ("x", "tail", "head", "mid", "rest")


def _class_grams(word_counts: DataFrame) -> DataFrame:
    """Every string x of 2 ... ORDER letters in the words, by hash: how often it is the
    n-gram of its last letter in each class (n0, n1; both 0 if only longer ones are), and
    the hashes of x without its first letter (tail), its last (head), both (mid) and its
    first two (rest)."""
    def run(batches):
        for b in slices(batches, 1 << 13):
            if not b.num_rows:
                continue
            n = [b[c].to_numpy().astype(np.int64) for c in ("n0", "n1")]
            h, word, place = _word_hashes(b["item"].to_pylist())
            for j in range(2, ORDER + 1):
                at = np.nonzero(place >= j)[0]
                if not len(at):
                    continue
                own = (place[at] == j) | (j == ORDER)
                _, first, of = np.unique(h[j, at], return_index=True, return_inverse=True)
                e = at[first]
                sums = [np.bincount(of, weights=np.where(own, c[word[at]], 0), minlength=len(e)).astype(np.int64) for c in n]
                strings = h[j, e], h[j - 1, e], h[j - 1, e - 1], h[j - 2, e - 1], h[j - 2, e]
                yield pa.record_batch([*(pa.array(c.view(np.int64)) for c in strings), pa.array(np.full(len(e), j, np.int32)),
                                       *(pa.array(c) for c in sums)], names=[*_STRINGS, "j", "n0", "n1"])

    return (word_counts.mapInArrow(run, ", ".join(f"{c} bigint" for c in _STRINGS) + ", j int, n0 bigint, n1 bigint")
                       .groupBy("x").agg(*(F.first(c).alias(c) for c in (*_STRINGS[1:], "j")),
                                         F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def gram_ratios(word_counts: DataFrame) -> DataFrame:
    """(h, seen, context) by hash: log(p1/p0) of the n-grams seen, of each context's backoff weight.

    A join key has at most as many rows as there are letters: those that can precede or
    follow one string."""
    strings = materialize(_class_grams(word_counts), "strings")
    # shared continuation counts: distinct longer strings before each shorter one
    short = strings.groupBy(F.col("tail").alias("s")).agg(
        F.count("*").alias("n"), F.first("mid").alias("ctx"), F.first("rest").alias("rest"), (F.first("j") - 1).alias("m"))
    short = materialize(short, "continuations")
    beside = short.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    parts = materialize(short.join(beside, "ctx").select(
        "s", "rest", "m", ((F.col("n") - DISCOUNT) / F.col("total")).alias("a"),
        (DISCOUNT * F.col("kinds") / F.col("total")).alias("b")), "backoff")
    floor = 1.0 / (parts.where("m = 1").count() + 1)
    shared = materialize(parts.where("m = 1").select("s", (F.col("a") + F.col("b") * floor).alias("q")), "shared")
    levels = [shared]
    for m in range(2, ORDER):
        below = levels[-1].select(F.col("s").alias("rest"), "q")
        levels.append(materialize(parts.where(F.col("m") == m).join(below, "rest").select(
            "s", (F.col("a") + F.col("b") * F.col("q")).alias("q")), "shared"))
    for level in levels[1:]:
        shared = shared.unionByName(level)
    own = strings.where("n0 + n1 > 0").join(shared.withColumnRenamed("s", "tail"), "tail").select("x", "head", "n0", "n1", "q")
    own = materialize(own, "own")
    kinds = lambda c: F.sum((F.col(c) > 0).cast("long"))
    heads = own.groupBy("head").agg(*(f(c).alias(f"{name}{c[1]}") for c in ("n0", "n1") for f, name in ((F.sum, "t"), (kinds, "k"))))
    weight = lambda c: F.when(F.col("t" + c) > 0, DISCOUNT * F.col("k" + c) / F.col("t" + c)).otherwise(1.0)
    heads = materialize(heads.select("head", "t0", "t1", weight("0").alias("w0"), weight("1").alias("w1")), "contexts")

    def prob(c):
        direct = F.when(F.col("t" + c) > 0, F.greatest(F.col("n" + c) - DISCOUNT, F.lit(0.0)) / F.col("t" + c)).otherwise(0.0)
        return direct + F.col("w" + c) * F.col("q")

    none = F.lit(None).cast("double")
    seen = own.join(heads, "head").select(F.col("x").alias("h"), F.log(prob("1") / prob("0")).alias("seen"), none.alias("context"))
    context = heads.select(F.col("head").alias("h"), none.alias("seen"), F.log(F.col("w1") / F.col("w0")).alias("context"))
    return materialize(seen.unionByName(context).groupBy("h").agg(F.max("seen").alias("seen"), F.max("context").alias("context")),
                       "ratios")


def word_ratios(vocabulary: DataFrame, ratios: DataFrame) -> DataFrame:
    """(item, n, ratio) for the distinct words (item, n)."""
    shards = max(MIN_SHARDS, -(-vocabulary.count() // SHARD_WORDS))
    dealt = vocabulary.withColumn("shard", F.pmod(F.xxhash64(F.lit(7), "item"), F.lit(shards)).cast("int"))

    def ask(batches):
        for b in slices(batches, 1 << 13):
            if not b.num_rows:
                continue
            h, word, place = _word_hashes(b["item"].to_pylist())
            at = np.nonzero(place > 1)[0]
            size = np.minimum(place[at], ORDER)
            shard = b["shard"].to_numpy()[word[at]].astype(np.int64)
            hashes = np.concatenate([h[size, at], h[size - 1, at - 1]]).view(np.int64)
            pairs = np.unique(np.stack([np.concatenate([shard, shard]), hashes]), axis=1)
            yield pa.record_batch([pa.array(pairs[0].astype(np.int32)), pa.array(pairs[1])], names=["shard", "h"])

    asked = dealt.select("item", "shard").mapInArrow(ask, "shard int, h bigint").distinct().join(ratios, "h")

    def answer(own: pa.Table, got: pa.Table) -> pa.Table:
        def part(name):                               # an entry 0, which no string has, keeps tables from being empty
            rows = got.filter(pa.compute.is_valid(got[name]))
            h = rows["h"].to_numpy().view(np.uint64)
            by = np.argsort(h)
            return np.append(np.uint64(0), h[by]), np.append(0.0, rows[name].to_numpy()[by])

        if not own.num_rows:
            return pa.table({"item": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "ratio": pa.array([], pa.float64())})
        table = Ratios(*part("seen"), *part("context"))
        return pa.table({"item": own["item"], "n": own["n"], "ratio": pa.array(table.words(own["item"].to_pylist()))})

    return dealt.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(answer, "item string, n bigint, ratio double")


def _vocabulary(src: DataFrame) -> DataFrame:
    """(item, n): the distinct words of all texts and how often they stand."""
    def run(batches):
        found: Counter = Counter()
        table = lambda: pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                                        names=["item", "n"])
        for b in slices(batches):
            for t in b["text"].to_pylist():
                found.update(words(t or ""))
            if len(found) > 1 << 19:
                yield table()
                found.clear()
        yield table()

    return src.select("text").mapInArrow(run, "item string, n bigint").groupBy("item").agg(F.sum("n").alias("n"))


def _common(ratios: DataFrame) -> dict[str, float]:
    """Ratios of the commonest words: counts from the least power of two that leaves at most COMMON_WORDS."""
    sizes = {r["b"]: r["count"] for r in ratios.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()}
    least, held = max(sizes, default=0) + 1, 0
    while least > 0 and held + sizes.get(least - 1, 0) <= COMMON_WORDS:
        least -= 1
        held += sizes.get(least, 0)
    got = ratios.where(F.floor(F.log2("n")).cast("int") >= least).select("item", "ratio").toArrow()
    return dict(zip(got["item"].to_pylist(), got["ratio"].to_pylist()))


@dataclass
class Model:
    ratios: DataFrame | None
    weights: np.ndarray          # of 1 and the features
    prior: float = 0.0


def features(df: DataFrame, ratios: DataFrame, key: str, text: str, *extra: str) -> DataFrame:
    """(key, extra columns, features) for every row."""
    src = df.select(F.col(key).alias("key"), F.col(text).alias("text"), *extra)
    known = materialize(word_ratios(materialize(_vocabulary(src), "vocabulary"), ratios), "word_ratios")
    shared = df.sparkSession.sparkContext.broadcast(_common(known))
    rest = src.drop("text").schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest)

    def run(batches):
        common = shared.value
        for b in slices(batches):
            out: list[list] = [[] for _ in range(4)]
            for t in b["text"].to_pylist():
                found = words(t or "")
                here = [common.get(w) for w in found]
                others = [w for w, r in zip(found, here) if r is None]
                if others:
                    here = [r for r in here if r is not None]
                for col, value in zip(out, (len(found), math.fsum(here), heapq.nlargest(TOP[-1], here), others)):
                    col.append(value)
            kinds = pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.string())
            yield pa.record_batch([*(b[f.name] for f in rest), *(pa.array(c, k) for c, k in zip(out, kinds))],
                                  names=[*(f.name for f in rest), "words", "total", "top", "others"])

    part = src.mapInArrow(run, f"{schema}, words bigint, total double, top array<double>, others array<string>")
    part = materialize(part.withColumn("row", F.monotonically_increasing_id()), "scored")
    other = (part.where(F.size("others") > 0).select("row", F.explode("others").alias("item")).join(known, "item")
                 .groupBy("row").agg(F.sum("ratio").alias("other_total"),
                                     F.slice(F.sort_array(F.collect_list("ratio"), asc=False), 1, TOP[-1]).alias("other_top")))
    best = F.sort_array(F.concat("top", F.coalesce("other_top", F.array().cast("array<double>"))), asc=False)
    mean = (F.col("total") + F.coalesce("other_total", F.lit(0.0))) / F.col("words")
    first = lambda k: F.aggregate(F.slice("best", 1, k), F.lit(0.0), lambda x, y: x + y) / k
    values = dict(zip(FEATURES, (mean, *(first(k) for k in TOP), F.log("words"))))
    return part.join(other, "row", "left").withColumn("best", best).select(
        *rest.names, *(F.when(F.col("words") > 0, x).otherwise(0.0).alias(c) for c, x in values.items()))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps (first column constant) over
    rows that each stand for ``weight`` rows."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-9] + [RIDGE] * (x.shape[1] - 1)) * weight.sum() ** 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(w)),
                               x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _choose(rows: DataFrame, bound: int, counts: dict) -> DataFrame:
    """At most about ``bound`` rows of each label, chosen by hash of the key."""
    draw = F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(F.when(F.col("label") == 1, draw < bound / max(1, counts.get(1, 0)))
                      .otherwise(draw < bound / max(1, counts.get(0, 0))))


def _labelled(labels: DataFrame, fold, key: str, label: str) -> tuple[DataFrame, dict]:
    """(key, label, fits) of the labelled documents, and their number by (fits, label)."""
    marked = (labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
                    .groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label")))
    marked = materialize(marked.withColumn("fits", fold(F.col("key"))), "labels")
    return marked, {(r["fits"], r["label"]): r["count"] for r in marked.groupBy("fits", "label").count().collect()}


def _fit(rows: DataFrame, fitting: dict) -> np.ndarray:
    """The curve's weights from (label, features) rows; ``fitting``: all labelled rows of the fit by label."""
    got = rows.select("label", *FEATURES).toArrow()
    x = np.stack([np.ones(got.num_rows), *(got[c].to_numpy() for c in FEATURES)], axis=1)
    y = got["label"].to_numpy().astype(float)
    weight = np.where(y == 1, *(max(1.0, fitting[k] / MAX_FIT_ROWS) for k in (1, 0)))
    return logistic(x, y, weight)


def _prepare(texts: DataFrame, labels: DataFrame, fold, key: str, label: str):
    """(share of label 1, n-gram ratios, rows that fit the curve, their number by label); no ratios
    unless both folds hold both labels."""
    marked, counts = _labelled(labels, fold, key, label)
    prior = sum(n for (_, y), n in counts.items() if y) / max(1, sum(counts.values()))
    if any((f, y) not in counts for f in (False, True) for y in (0, 1)):
        return prior, None, None, {}
    fitting = {y: n for (f, y), n in counts.items() if f}
    ratios = gram_ratios(_class_words(texts.join(marked.where("not fits"), "key")))
    return prior, ratios, _choose(marked.where("fits"), MAX_FIT_ROWS, fitting).select("key", "label"), fitting


def train(docs: DataFrame, labels: DataFrame, fold, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """``fold``: boolean column over (key): true for the labelled rows that fit the
    logistic curve, false for those that are counted."""
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    prior, ratios, chosen, fitting = _prepare(texts, labels, fold, key, label)
    if ratios is None:
        return Model(None, np.zeros(1 + len(FEATURES)), prior)
    rows = texts.join(F.broadcast(chosen), "key")     # bounded by MAX_FIT_ROWS
    return Model(ratios, _fit(features(rows, ratios, "key", "text", "label"), fitting), prior)


def _scored(feats: DataFrame, weights: np.ndarray, key: str) -> DataFrame:
    w = [float(x) for x in weights]
    z = F.lit(w[0]) + sum(F.col(c) * x for c, x in zip(FEATURES, w[1:]))
    return feats.select(F.col("key").alias(key), (1 / (1 + F.exp(-z))).alias("score"))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row."""
    if model.ratios is None:
        return docs.select(key, F.lit(float(model.prior)).alias("score"))
    return _scored(features(docs, model.ratios, key, text), model.weights, key)


def train_and_score(docs: DataFrame, labels: DataFrame, fold, key: str = "doc_id", text: str = "text",
                    label: str = "toxic") -> DataFrame:
    """``score(docs, train(docs, labels, fold))`` with the words' ratios and every row's features made once."""
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    prior, ratios, chosen, fitting = _prepare(texts, labels, fold, key, label)
    if ratios is None:
        return docs.select(key, F.lit(float(prior)).alias("score"))
    feats = materialize(features(texts, ratios, "key", "text"), "features")
    return _scored(feats, _fit(feats.join(F.broadcast(chosen), "key"), fitting), key)
