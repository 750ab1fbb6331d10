"""Repeated byte strings across documents, by two-stage suffix sorting.

Every byte that a string of ``length`` bytes covers is removed if the same string
also starts earlier (in a smaller document, or earlier in the same one).  Strings
never cross documents and are judged on the input, not on what is left.

Sharding without loss: a window of ``length`` bytes is keyed by the smallest hash
among its ``GRAM``-byte grams, so equal windows have equal keys.  Neighbouring
windows mostly share their key, so a document falls into runs of windows, each
shipped once as a slice of text.  Keys seen once cannot repeat: a first pass
counts them, and a filter of fixed size (``BLOOM_BITS``, built in slices) keeps
their runs from being shipped; what it lets through by mistake only costs work.
Equal slices of one task are shipped once (the later ones are copies).

A task sorts the suffixes that start its windows: only suffixes smaller than
their successor are sorted directly, the others are induced from them by one
scan over the byte buckets; neighbours whose common prefix reaches ``length``
are one class, whose earliest member stays.  A key with more than ``hot_rows``
slices is cut into single windows, keyed by their whole content, which spreads
it over all tasks.

A document order of (key, hash of the text) makes repeated keys well defined:
rows equal in both are one document and get the same answer; a null key comes
first.  Keys are of any type that sorts: whole numbers are used as they are, others
(text by its UTF-8 bytes) get numbers in their order from one distributed sort.  Null and short texts lose nothing.  Texts are read whole.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from netlens.llm.common import materialize, slices

LENGTH = 100
GRAM = 32
BLOOM_BITS = 26                  # log2 of the filter's bits (8 MB)
SLICE_BITS = 20                  # log2 of the bits one task of the filter builds
TASK_ROWS = 16_000               # slices a suffix-sorting task is meant to hold
HOT_ROWS = 20_000
BATCH_BYTES = 1 << 18
NULL_KEY = -(1 << 63)            # a null key comes first
SEEN_SLICES = 1 << 20            # slices a worker remembers to find equal ones

_rng = np.random.Generator(np.random.Philox(key=2003))
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _sliding(x: np.ndarray, span: int, best) -> np.ndarray:
    """best (minimum or maximum) of each ``span`` neighbours."""
    size = 1
    while size * 2 <= span:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[:len(x) - (span - size)], x[span - size:]) if span > size else x


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    h, size = _BYTE[text], 1
    while size < GRAM:
        h = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ h >> np.uint64(32)


def _periodic_keys(h: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """Keys whose smallest gram stands twice in reach of one window or of two neighbours
    (which share a run, too): only there can two windows of one run be equal, so these
    keys count as seen more than once."""
    span = length - GRAM + 1
    edge = np.zeros(span - 1, np.uint64)
    chosen = np.nonzero(h == _sliding(np.concatenate([edge, key, edge]), span, np.maximum))[0]
    again = (h[chosen[1:]] == h[chosen[:-1]]) & (np.diff(chosen) <= span)
    return h[chosen[1:][again]]


def _documents(batches, length: int):
    """Runs of a few documents at a time: (batch, document rows, text, document starts,
    run's document, run's start in the text, windows in it, key, gram hashes, window keys)."""
    for b in batches:
        col = b["text"].cast(pa.binary())
        ends, data = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1], col.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH_BYTES)) - 1)
            first = ends[at:to + 1] - ends[at]
            text = data[ends[at]:ends[to]]
            rows = np.arange(at, to)
            at = to
            if len(text) < length:
                continue
            h = _gram_hashes(text)
            key = _sliding(h, length - GRAM + 1, np.minimum)
            doc = np.repeat(np.arange(len(rows)), np.diff(first))[:len(key)]
            start = np.arange(len(key))
            inside = start + length <= first[1:][doc]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            begin = np.nonzero(new & inside)[0]
            if not len(begin):
                continue
            # a run ends at the next begin or with the windows of its document
            cut = np.nonzero(new | ~inside)[0]
            end = np.append(cut, len(key))[np.searchsorted(cut, begin, side="right")]
            yield b, rows, text, first, doc[begin], begin, end - begin, key[begin], h, key


def _source(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, o1, o2, text): o1, o2 order the documents.  o1 is the key if that is a whole
    number, else a number in the order of the keys, written once."""
    t = F.coalesce(F.col(text), F.lit(""))
    src = df.select(F.col(key).alias("key"), F.xxhash64(t).alias("o2"), t.alias("text"))
    if isinstance(df.schema[key].dataType, IntegralType):
        return src.select("key", F.coalesce(F.col("key").cast("long"), F.lit(NULL_KEY)).alias("o1"), "o2", "text")
    places = materialize(src.where("key is not null").select(F.col("key").alias("place")).distinct().sort("place")
                            .withColumn("o1", F.monotonically_increasing_id()), "places")
    return (src.join(places, F.col("key") == F.col("place"), "left")
               .select("key", F.coalesce("o1", F.lit(NULL_KEY)).alias("o1"), "o2", "text"))


def _bits(key: np.ndarray, bits: int):
    """Two places per key; keys are smallest hashes, so they are mixed again to spread."""
    yield (key * _MIX) >> np.uint64(64 - bits)
    yield ((key ^ key >> np.uint64(32)) * np.uint64(_BASE)) >> np.uint64(64 - bits)


def _filter(src: DataFrame, length: int, bits: int) -> np.ndarray:
    """Bit array of the keys that occur more than once."""
    def keys(batches):
        for *_, own, h, key in _documents(batches, length):
            k, n = np.unique(np.concatenate([own, _periodic_keys(h, key, length)]), return_counts=True)
            yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(n)], names=["key", "n"])

    twice = (src.select("text").mapInArrow(keys, "key bigint, n bigint")
                .groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"))

    def places(batches):
        for b in batches:
            at = np.concatenate([*_bits(b["key"].to_numpy().view(np.uint64), bits)]).astype(np.int64)
            yield pa.record_batch([pa.array(at >> SLICE_BITS), pa.array((at & ((1 << SLICE_BITS) - 1)).astype(np.int32))],
                                  names=["slice", "bit"])

    def fill(batches):
        own: dict[int, np.ndarray] = {}
        for b in batches:
            part, bit = b["slice"].to_numpy(), b["bit"].to_numpy()
            for s in np.unique(part):
                own.setdefault(int(s), np.zeros(1 << SLICE_BITS, bool))[bit[part == s]] = True
        yield pa.record_batch([pa.array(list(own), pa.int64()),
                               pa.array([np.packbits(x).tobytes() for x in own.values()], pa.binary())], names=["slice", "bits"])

    parts = max(1, 1 << (bits - SLICE_BITS))
    rows = (twice.mapInArrow(places, "slice bigint, bit int").repartition(parts, "slice")
                 .mapInArrow(fill, "slice bigint, bits binary").toArrow())
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (SLICE_BITS - 3)
    for s, x in zip(rows["slice"].to_pylist(), rows["bits"].to_pylist()):
        out[s * size:(s + 1) * size] = np.frombuffer(x, np.uint8)
    return out


SLICE_SCHEMA = "key bigint, o1 bigint, o2 bigint, start int, n int, slice binary"


def _rows(key, o1, o2, start, n, pieces):
    return pa.record_batch([pa.array(np.asarray(key, np.uint64).view(np.int64)), pa.array(o1, pa.int64()), pa.array(o2, pa.int64()),
                            pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(pieces, pa.binary())],
                           names=["key", "o1", "o2", "start", "n", "slice"])


def _slices(src: DataFrame, twice: np.ndarray, length: int, bits: int) -> DataFrame:
    """Runs whose key may repeat.  The slice is null where the task has already met an
    equal slice that comes earlier: such a run is a copy from end to end."""
    shared = src.sparkSession.sparkContext.broadcast(twice)

    def run(batches):
        known = shared.value
        seen = _Seen()
        for b, rows, text, first, doc, begin, n, key, _, _ in _documents(batches, length):
            hit = np.ones(len(key), bool)
            for at in _bits(key, bits):
                hit &= (known[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
            if not hit.any():
                continue
            doc, begin, n, key = doc[hit], begin[hit], n[hit], key[hit]
            o1, o2 = b["o1"].to_numpy()[rows][doc], b["o2"].to_numpy()[rows][doc]
            start = begin - first[doc]
            raw, out = text.tobytes(), []
            for i, m, order in zip(begin.tolist(), n.tolist(), zip(o1.tolist(), o2.tolist(), start.tolist())):
                piece = raw[i:i + m + length - 1]
                out.append(piece if seen.new(piece, order) else None)
            yield _rows(key, o1, o2, start, n, out)

    return src.select("o1", "o2", "text").mapInArrow(run, SLICE_SCHEMA)


class _Seen(dict):
    """Earliest place of the slices a task has met."""

    def new(self, s: bytes, order: tuple) -> bool:
        """Whether no equal slice came earlier."""
        if len(self) > SEEN_SLICES:
            self.clear()
        digest = hashlib.blake2b(s, digest_size=16).digest()
        other = self.setdefault(digest, order)
        if order < other:
            self[digest] = order
        return order <= other


def _prefix_sort(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ordered by their first ``depth`` bytes (rounded up to eights)."""
    words = np.ndarray((len(text) - 7,), ">u8", text.data, strides=(1,))
    k = words[at].astype(np.uint64)
    by = np.argsort(k, kind="stable")
    at, k = at[by], k[by]
    new = np.ones(len(at), bool)
    new[1:] = k[1:] != k[:-1]
    for d in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        rows = np.nonzero(tied)[0]
        if not len(rows):
            break
        group = np.cumsum(new)[rows]
        k = words[np.minimum(at[rows] + d, len(words) - 1)].astype(np.uint64)
        by = np.lexsort((k, group))
        at[rows], k = at[rows][by], k[by]
        # groups keep their places; a new one begins where the next eight bytes differ
        new[rows[1:]] |= k[1:] != k[:-1]
    return at


def suffix_order(text: np.ndarray, need: np.ndarray, rising: np.ndarray, depth: int) -> np.ndarray:
    """The needed suffixes in order (to ``depth`` bytes).  ``rising``: suffixes smaller
    than their successor, which are sorted directly; a needed falling suffix is
    followed by a needed suffix, from which it is induced."""
    direct = _prefix_sort(text, np.nonzero(need & rising)[0], depth)
    cuts = np.searchsorted(text[direct], np.arange(257))
    falling = need & ~rising
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        here = waiting[c]
        step = np.concatenate(here) if here else np.empty(0, np.int64)
        while len(step):                              # a run of equal bytes induces in its own bucket
            step = step[step > 0] - 1
            step = step[falling[step] & (text[step] == c)]
            if len(step):
                here.append(step)
        bucket = np.concatenate([*here, direct[cuts[c]:cuts[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[falling[before] & (text[before] > c)]
        byte = text[before]
        by = np.argsort(byte, kind="stable")
        before, byte = before[by], byte[by]
        ends = np.nonzero(np.diff(byte))[0] + 1
        for part in np.split(before, ends) if len(before) else ():
            waiting[text[part[0]]].append(part)
        waiting[c] = []
    return np.concatenate(out) if out else np.empty(0, np.int64)


def window_classes(pieces: list[bytes], n: np.ndarray, length: int):
    """(slice, offset, class) of every window, equal windows sharing a class."""
    sizes = np.array([len(s) for s in pieces]) + 1
    base = np.cumsum(sizes) - sizes
    # UTF-8 has no byte 255, so bytes move up by one and 0 ends every slice
    text = np.zeros(int(sizes.sum()) + length + 16, np.uint8)
    joined = np.frombuffer(b"\xff".join(pieces), np.uint8)
    text[:len(joined)] = joined + np.uint8(1)
    here, following = text[:-1], text[1:]
    differs = np.nonzero(here != following)[0]
    # a suffix compares to its successor as the first unequal neighbours after it do
    nearest = differs[np.minimum(np.searchsorted(differs, np.arange(len(here))), len(differs) - 1)]
    rising = np.append(here[nearest] < following[nearest], False)
    rising[base + sizes - 1] = True                   # the empty rest of a slice
    up = np.nonzero(rising)[0]
    last = up[np.searchsorted(up, base + n - 1)]
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, base, 1)
    np.add.at(edge, last + 1, -1)
    need = np.cumsum(edge[:-1]) > 0
    order = suffix_order(text, need, rising, length)
    owner = np.searchsorted(base, order, side="right") - 1
    offset = order - base[owner]
    window = offset < n[owner]
    order, owner, offset = order[window], owner[window], offset[window]
    words = np.ndarray((len(text) - 7,), np.uint64, text.data, strides=(1,))
    same = np.arange(1, len(order))
    for d in [*range(0, length - 7, 8), length - 8]:
        if not len(same):
            break
        same = same[words[order[same - 1] + d] == words[order[same] + d]]
    new = np.ones(len(order), bool)
    new[same] = False
    return owner, offset, np.cumsum(new)


def _judge(key, o1, o2, start, n, pieces, length: int):
    """(o1, o2, start, n) runs of windows that start earlier elsewhere, of one task's slices."""
    rows = np.lexsort((start, o2, o1))
    first: dict[tuple, int] = {}
    copies, alone = [], []
    for r in rows.tolist():                           # in document order: later equal slices are copies
        k = (int(key[r]), pieces[r])
        if k not in first:
            first[k] = r
            alone.append(r)
        elif (o1[r], o2[r], start[r]) != (o1[first[k]], o2[first[k]], start[first[k]]):
            copies.append(r)
    out = [(o1[copies], o2[copies], start[copies], n[copies])]
    alone = np.array(alone)
    owner, offset, group = window_classes([pieces[r] for r in alone], n[alone], length)
    # members of a class in document order; all but the first go
    at = start[alone[owner]] + offset
    by = np.lexsort((at, _document_rank(o1, o2, alone)[owner], group))
    owner, offset, at, group = owner[by], offset[by], at[by], group[by]
    later = np.zeros(len(group), bool)
    later[1:] = group[1:] == group[:-1]
    # the same place of a document may stand in two slices when a worker met it twice
    leader = np.maximum.accumulate(np.where(later, 0, np.arange(len(group))))
    r, f = alone[owner], alone[owner[leader]]
    later &= (o1[r] != o1[f]) | (o2[r] != o2[f]) | (at != at[leader])
    owner, offset = owner[later], offset[later]
    by = np.lexsort((offset, owner))
    owner, offset = owner[by], offset[by]
    if len(owner):
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)
        begin = np.nonzero(new)[0]
        r = alone[owner[begin]]
        out.append((o1[r], o2[r], start[r] + offset[begin], np.diff(np.append(begin, len(owner)))))
    return [np.concatenate(c) for c in zip(*out)]


def _document_rank(o1, o2, rows):
    """Rank of each row's document among the rows."""
    by = np.lexsort((o2[rows], o1[rows]))
    a, b = o1[rows][by], o2[rows][by]
    rank = np.empty(len(rows), np.int64)
    rank[by] = np.cumsum(np.append(0, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return rank


FOUND = "o1 bigint, o2 bigint, start int, n int"


def _single_windows(rows: DataFrame, length: int) -> DataFrame:
    """Slices of crowded keys, cut into windows that are keyed by their content; the
    slice is null for a window the task has already met earlier in document order."""
    def run(batches):
        seen = _Seen()
        for b in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for o1, o2, start, n, s in zip(*(b[c].to_pylist() for c in ("o1", "o2", "start", "n", "slice"))):
                for i in range(n):
                    w = s[i:i + length]
                    row = (int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little"), o1, o2, start + i, 1,
                           w if seen.new(w, (o1, o2, start + i)) else None)
                    for col, x in zip(out, row):
                        col.append(x)
            yield _rows(*out)

    return rows.mapInArrow(run, SLICE_SCHEMA)


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
            bits: int = BLOOM_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(o1, o2, start, n): n windows from byte start on also start earlier.  o1 is a whole-number
    key (a null one the least long), o2 ``xxhash64`` of the text."""
    return _repeats(_source(df, key, text), length, bits, hot_rows)


def _repeats(src: DataFrame, length: int, bits: int = BLOOM_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    if length < GRAM:
        raise ValueError(f"strings of at least {GRAM} bytes")
    found = materialize(_slices(src, _filter(src, length, bits), length, bits), "slices")
    copies = found.where("slice is null").select("o1", "o2", "start", "n")
    shipped = found.where("slice is not null")
    counts = shipped.groupBy("key").agg(F.count("*").alias("rows"))
    hot = materialize(counts.where(F.col("rows") > hot_rows).select("key"), "hot")
    if not hot.isEmpty():
        windows = materialize(_single_windows(shipped.join(hot, "key", "left_semi").select(*found.columns), length), "windows")
        copies = copies.unionByName(windows.where("slice is null").select(*copies.columns))
        shipped = (shipped.join(hot, "key", "left_anti").select(*found.columns)
                          .unionByName(windows.where("slice is not null")))
    tasks = max(1, -(-shipped.count() // TASK_ROWS))

    def work(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        cols = [np.concatenate([b[c].to_numpy() for b in held]) for c in ("key", "o1", "o2", "start", "n")]
        pieces = [s for b in held for s in b["slice"].to_pylist()]
        o1, o2, start, n = _judge(*cols, pieces, length)
        yield pa.record_batch([pa.array(o1), pa.array(o2), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                              names=["o1", "o2", "start", "n"])

    parallel = src.sparkSession.sparkContext.defaultParallelism
    judged = shipped.repartition(max(tasks, parallel), "key").mapInArrow(work, FOUND)
    return copies.unionByName(materialize(judged, "judged"))


def remove(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
           with_text: bool = False, **options) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) for every row."""
    src = _source(df, key, text)
    found = _repeats(src, length, **options)
    per_doc = materialize(found.groupBy("o1", "o2").agg(F.collect_list(F.struct("start", "n")).alias("runs")), "per_doc")
    joined = src.join(per_doc, ["o1", "o2"], "left").select("key", "text", "runs")
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def run(batches):
        for b in batches:
            out = []
            for t, runs in zip(b["text"].to_pylist(), b["runs"].to_pylist()):
                raw, kept, at, gone, spans, end = t.encode("utf-8"), [], 0, 0, 0, -1
                for r in sorted(runs or (), key=lambda r: r["start"]):
                    lo, hi = r["start"], r["start"] + r["n"] + length - 1
                    if lo > end:                      # touching runs are one span
                        kept.append(raw[at:lo])
                        spans += 1
                        gone += hi - lo
                        end = at = hi
                    elif hi > end:
                        gone += hi - end
                        end = at = hi
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((len(raw), gone, spans, hashlib.sha256(left).hexdigest(), left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([b["key"], *(pa.array([x[k] for x in out], kinds[k]) for k in range(len(names) - 1))], names=names)

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    return joined.mapInArrow(run, schema).withColumnRenamed("key", key)
