"""Byte-level BPE encoding and decoding.

Encoding merges each pre-token with a priority queue of merge ranks over a
doubly linked symbol list: the lowest rank (leftmost on ties) is popped, an
entry whose symbols have changed meanwhile is stale and skipped, and a merge
pushes the two pairs it creates.  Decoding concatenates the vocabulary strings
of the ids and maps them back to bytes.

The vocabulary file is a parameter; it is read once per Python worker.  Work is
per document, so nothing is shuffled; a pre-token's ids are remembered in a
dictionary of bounded size.  Null texts encode to no ids; a null id list
decodes to the empty text.  Texts of any length are encoded whole.
"""
from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import slices

# fixed values: the printable stand-ins of bytes in every byte-level vocabulary file
# of this kind, and the contractions and blanks of its pre-token pattern
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
CONTRACTIONS = "'(?:s|t|re|ve|m|ll|d)"
BLANKS = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ID_BITS = 20


def pre_token() -> str:
    """The pre-token pattern: contractions; runs of letters, of numbers, of neither
    (each with one space before it); blanks, without the last one before a word.

    Letters and numbers are spelled out as ranges because the faster ``re`` has no
    property classes; the first branch is the common case, plain letters up to an
    ASCII character that is no letter."""
    letters, numbers = _ranges("L"), _ranges("N")
    return (r" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]++(?=[\x00-\x40\x5b-\x60])"
            rf"|{CONTRACTIONS}| ?[{letters}]+| ?[{numbers}]+"
            rf"| ?[^{BLANKS}{letters}{numbers}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")


def _ranges(category: str) -> str:
    """A character class of all code points of a general category."""
    found = regex.findall(rf"\p{{{category}}}+", "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000)))))
    # neighbours in the text are neighbours in code, except across the surrogates
    return "".join(f"\\U{ord(r[0]):08x}-\\U{ord(r[-1]):08x}" for r in found)


#: Remembered pre-tokens per worker; the memory is emptied when it is full.
CACHE_WORDS = 1 << 19


def byte_chars() -> list[str]:
    """The character that stands for each byte in the vocabulary strings."""
    shown, spare = set(SHOWN), iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        chars = byte_chars()
        byte_of = {c: bytes([b]) for b, c in enumerate(chars)}
        self.byte_ids = [vocab[c] for c in chars]
        self.pieces: dict[int, bytes] = {}
        for s, i in chain(vocab.items(), self.special.items()):
            self.pieces[i] = b"".join(byte_of.get(c) or c.encode() for c in s)
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left] << ID_BITS | vocab[right]] = rank
            self.merged.append(vocab[left + right])
        self.pattern = re.compile(pre_token())
        self.split_special = re.compile(
            "(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
        ) if self.special else None
        self.known = _Words(self)
        # the vocabulary strings on end, to gather the bytes of many ids at once
        size = np.zeros(max(self.pieces) + 1, np.int64)
        for i, piece in self.pieces.items():
            size[i] = len(piece)
        self.size, self.start = size, np.cumsum(size) - size
        self.blob = np.frombuffer(b"".join(self.pieces.get(i, b"") for i in range(len(size))), np.uint8)

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token.  A queue entry is a rank and a position in one number;
        it is stale if the symbols now at its position no longer have that rank."""
        sym = [self.byte_ids[b] for b in word.encode("utf-8")]
        n, rank_of = len(sym), self.ranks.get
        bits = n.bit_length()
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [r << bits | i for i in range(n - 1) if (r := rank_of(sym[i] << ID_BITS | sym[i + 1])) is not None]
        heapq.heapify(queue)
        at = (1 << bits) - 1
        while queue:
            entry = heapq.heappop(queue)
            i, rank = entry & at, entry >> bits
            j = nxt[i]
            if j >= n or rank_of(sym[i] << ID_BITS | sym[j]) != rank:
                continue
            new = sym[i] = self.merged[rank]
            k = nxt[i] = nxt[j]
            sym[j], nxt[j] = -1, n
            if k < n:
                prev[k] = i
                if (r := rank_of(new << ID_BITS | sym[k])) is not None:
                    heapq.heappush(queue, r << bits | i)
            if (h := prev[i]) >= 0 and (r := rank_of(sym[h] << ID_BITS | new)) is not None:
                heapq.heappush(queue, r << bits | h)
        return tuple(s for s in sym if s >= 0)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        find, known = self.pattern.findall, self.known.__getitem__
        if self.split_special is None or not any(s in text for s in self.special):
            return np.frombuffer(b"".join(map(known, find(text))), np.int32)
        parts = [np.array([self.special[p]], np.int32).tobytes() if p in self.special else b"".join(map(known, find(p)))
                 for p in self.split_special.split(text)]
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int32)).decode("utf-8", "replace")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The vocabulary strings of the ids on end."""
        size = self.size[ids]
        ends = np.cumsum(size)
        shift = np.repeat(self.start[ids] - ends + size, size)
        return self.blob[shift + np.arange(len(shift))].tobytes()


class _Words(dict):
    """Ids of the pre-tokens met, each as the bytes of its 32-bit numbers."""

    def __init__(self, model: Bpe):
        super().__init__()
        self.merge = model.merge

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = np.array(self.merge(word), np.int32).tobytes()
        return ids


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(df: DataFrame, vocab_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for every row; null or empty text: no ids."""
    src = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        model = load(vocab_path)
        for b in slices(batches):
            own = [model.encode(t or "") for t in b["text"].to_pylist()]
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))
            yield pa.record_batch([b["key"], ids], names=["key", "ids"])

    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, vocab_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, text): the ids stay beside the decoded text; null ids: empty text."""
    src = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))

    def run(batches):
        model = load(vocab_path)
        for b in slices(batches):
            ids = b["ids"]
            ends, flat = ids.offsets.to_pylist(), ids.values.to_numpy()
            texts = [model.decode(flat[i:j]) if null is False else ""
                     for i, j, null in zip(ends, ends[1:], ids.is_null().to_pylist())]
            yield pa.record_batch([b["key"], b["ids"], pa.array(texts, pa.string())],
                                  names=["key", "ids", "text"])

    kind = src.schema["key"].dataType.simpleString()
    return (src.mapInArrow(run, f"key {kind}, ids array<int>, text string")
               .withColumnsRenamed({"key": key, "ids": ids}))


def digests(df: DataFrame) -> DataFrame:
    """n_tokens and the two digests of (doc_id, ids, text) rows."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                     F.sha2(joined, 256).alias("ids_sha256"),
                     F.sha2(F.col("text"), 256).alias("decoded_sha256"))
