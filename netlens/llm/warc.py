"""WARC archives compressed with Zstandard (``.warc.zst``).

An archive starts with a skippable frame that holds a Zstandard dictionary,
followed by one frame per record.  The writer trains each archive's dictionary on
its first ``DICT_RECORDS`` records and rolls to a new archive at
``ARCHIVE_BYTES``; the reader loads the dictionary from the leading frame,
decodes frame by frame, and checks every record: version line, required header
fields, block length, the closing blank lines, HTTP header and payload length,
and the payload's SHA-1.

Archives are written by tasks into the shared folder under a name that is unique
to the attempt; a table of the committed paths is what readers go by, so files
left by a lost or repeated task are never read.

Payloads of ``MIN_REVISIT`` bytes or more that occur several times are stored
once, in the record with the largest key; the others become ``revisit`` records
that refer to it.  The group's largest key comes from one combined aggregate by
digest and is written before the join, so a payload shared by a third of all
pages is counted map-side and its join key can be split.

Null payloads are empty; null URLs are left out of the header; a null key is
written as ``null`` and revisits any equal payload that has a key.  An empty
table writes no archive and reads back as no record.
"""
from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm.common import materialize, shared_path
from netlens.sources.fs import resolve

# fixed values of the file format
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"

MIN_REVISIT = 1000
DICT_RECORDS = 512
DICT_BYTES = 16 * 1024
DICT_SAMPLE = 32 * 1024          # bytes of a record the dictionary is trained on
ARCHIVE_BYTES = 32 << 20
CHUNK = 32 * 1024
DATE = "2020-01-01T00:00:00Z"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    pass


def sha1_text(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def uri_text(url: str) -> str:
    """A URL as a header value: control characters percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def record(key: str, url: str | None, payload: bytes, kind: str, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC record; a revisit keeps the HTTP header but not the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:record:{key}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", uri_text(url)))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:record:{refers_to}>")]
    head += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", sha1_text(payload)),
             ("WARC-Block-Digest", sha1_text(block)), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parse_headers(data: bytes) -> dict[str, str]:
    out = {}
    for line in data.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ArchiveError(f"header line without a name: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def parse(data: bytes) -> dict:
    """A decoded record, checked; raises ArchiveError."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if not gap or first != VERSION:
        raise ArchiveError("no WARC header")
    h = parse_headers(lines)
    if missing := [k for k in REQUIRED if k not in h]:
        raise ArchiveError(f"header fields missing: {missing}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError("the block's length differs from Content-Length")
    block = rest[:-4]
    if "warc-block-digest" in h and sha1_text(block) != h["warc-block-digest"]:
        raise ArchiveError("the block's digest differs")
    kind, uid = h["warc-type"], lambda s: s and s.removeprefix("<urn:record:").removesuffix(">")
    out = {"record_id": uid(h["warc-record-id"]), "record_type": kind, "uri": h.get("warc-target-uri"),
           "refers_to": uid(h.get("warc-refers-to")), "payload": None, "payload_bytes": None, "payload_digest": None}
    if kind not in ("response", "revisit"):
        return out
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise ArchiveError("no HTTP header")
    size = parse_headers(lines).get("content-length", "")
    if not size.isdigit() or (kind == "response") * int(size) != len(payload):
        raise ArchiveError("the payload's length differs from the HTTP header")
    if "warc-payload-digest" not in h or kind == "revisit" and "warc-refers-to" not in h:
        raise ArchiveError(f"a {kind} without digest or reference")
    if kind == "response" and sha1_text(payload) != h["warc-payload-digest"]:
        raise ArchiveError("the payload's digest differs")
    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
    return out | {"payload": payload if kind == "response" else None, "payload_bytes": int(size), "payload_digest": digest}


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary, or nothing if the samples are too few or too alike for one."""
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, [s[:DICT_SAMPLE] for s in samples]).as_bytes()
    except zstandard.ZstdError:
        return b""


def frames(read):
    """The decoded frames of an archive, by its read(n) function."""
    data = read(CHUNK)
    dictionary = None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == DICT_MAGIC:
        size = struct.unpack("<I", data[4:8])[0]
        parts, have = [data[8:]], len(data) - 8
        while have < size and (more := read(CHUNK)):
            parts.append(more)
            have += len(more)
        data = b"".join(parts)
        if len(data) < size:
            raise ArchiveError("the dictionary frame is cut")
        raw, data = data[:size], data[size:]
        if raw.startswith(FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        if raw:
            dictionary = zstandard.ZstdCompressionDict(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data or (data := read(CHUNK)):
        frame, parts = decoder.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := read(CHUNK)):
                raise ArchiveError("the last frame is cut")
        yield b"".join(parts)


class _Writer:
    def __init__(self, folder: str):
        self.folder, self.out, self.done, self.waiting = folder, None, [], []

    def add(self, data: bytes) -> None:
        if self.out is not None:
            self._write(data)
        else:
            self.waiting.append(data)
            if len(self.waiting) >= DICT_RECORDS or sum(map(len, self.waiting)) >= ARCHIVE_BYTES:
                self._start()

    def _start(self) -> None:
        raw = train_dictionary(self.waiting)
        self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        fs, path = resolve(self.path)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.records, self.size = fs.open_output_stream(path), 0, 0
        self.out.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
        self.encoder = zstandard.ZstdCompressor(
            level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        waiting, self.waiting = self.waiting, []
        for w in waiting:
            self._write(w)

    def _write(self, data: bytes) -> None:
        frame = self.encoder.compress(data)
        self.out.write(frame)
        self.records += 1
        self.size += len(frame)
        if self.size >= ARCHIVE_BYTES:
            self._close()

    def _close(self) -> None:
        self.out.close()
        self.out = None
        self.done.append((self.path, self.records))

    def finish(self) -> list[tuple[str, int]]:
        if self.waiting:
            self._start()
        if self.out is not None:
            self._close()
        return self.done


def plan_records(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(key, url, payload binary, kind, refers_to): what each row is written as."""
    p = df.select(F.col(key).alias("key"), F.col(url).alias("url"),
                  F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.when(F.length("payload") >= MIN_REVISIT, F.sha1("payload")))
    first = materialize(p.where("digest is not null").groupBy("digest").agg(F.max("key").alias("first"), F.count("*").alias("n"))
                        .where("n > 1 and first is not null").select(F.col("digest").alias("d"), "first"), "first")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return p.join(first, F.col("digest") == F.col("d"), "left").select(
        "key", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame) -> DataFrame:
    """Write (key, url, payload, kind, refers_to) rows; (path, records) of the archives."""
    folder = shared_path(records.sparkSession, "warc")

    def run(batches):
        w = _Writer(folder)
        for b in batches:
            for key, url, payload, kind, refers_to in zip(*(b[c].to_pylist() for c in ("key", "url", "payload", "kind", "refers_to"))):
                w.add(record("null" if key is None else str(key), url, payload, kind, refers_to))
        done = w.finish()
        yield pa.record_batch([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())],
                              names=["path", "records"])

    cols = records.select("key", "url", "payload", "kind", "refers_to")
    return materialize(cols.mapInArrow(run, "path string, records bigint"), "archives")


def read_archives(spark: SparkSession, paths: DataFrame, with_payload: bool = True, strict: bool = True) -> DataFrame:
    """The records of the archives in ``paths`` (column path).  A record that fails a
    check raises ArchiveError, or with ``strict=False`` is a row with its ``error``."""
    n = paths.count()
    names = ["record_id", "record_type", "uri", "refers_to", "payload_bytes", "payload_digest", "error"] + ["payload"] * with_payload
    types = {"payload_bytes": pa.int64(), "payload": pa.binary()}

    def rows(path):
        fs, p = resolve(path)
        with fs.open_input_stream(p) as f:
            try:
                for data in frames(f.read):
                    try:
                        yield parse(data) | {"error": None}
                    except ValueError as e:
                        if strict:
                            raise ArchiveError(f"{path}: {e}") from e
                        yield {"error": str(e)}
            except (ArchiveError, zstandard.ZstdError) as e:
                if strict:
                    raise
                yield {"error": str(e)}

    def batch(got):
        return pa.record_batch([pa.array([r.get(c) for r in got], types.get(c, pa.string())) for c in names], names=names)

    def run(batches):
        for b in batches:
            for path in b["path"].to_pylist():
                got, size = [], 0
                for r in rows(path):
                    if not with_payload:
                        r["payload"] = None
                    got.append(r)
                    size += len(r.get("payload") or b"")
                    if len(got) >= 4096 or size >= 8 << 20:
                        yield batch(got)
                        got, size = [], 0
                yield batch(got)

    schema = ", ".join(f"{c} {'bigint' if c == 'payload_bytes' else 'binary' if c == 'payload' else 'string'}" for c in names)
    # one archive a task: their number is set here so that small listings aren't merged
    return paths.select("path").repartition(max(1, min(n, 8192)), "path").mapInArrow(run, schema)
