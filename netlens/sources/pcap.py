"""Packet-capture source (S5, S6, P8, W2 exact form).

``read_packets`` lists ``*.pcap``/``*.cap``/``*.pcapng`` files (or takes one file
or a list) and emits one row per record: ``source, chunk_id, packet_no, kept_no,
ts_us, frame``.  Decoding happens later with Column expressions
(:func:`netlens.functions.decode.decode_frames`).

* a capture is a sequence of variable-length records without an index, so it is read
  in two passes: a task a file walks the record headers, seeks over the payloads and
  writes a split row every ``split_bytes`` (byte range, chunk and packet counters,
  byte order, interface table); the splits are then read by as many tasks, each
  starting from the counters of its row.  A lost task costs one split, and one large
  capture uses all executors.  Where no file is larger than ``split_bytes``, the
  ``pcap`` Python DataSource reads a file a task without an index;
* pcap (micro- and nanosecond, either byte order) and pcapng (enhanced and
  simple packet blocks, per-interface timestamp resolution);
* a truncated final record ends the file quietly;
* ``max_packets`` counts records before any filtering (P8);
* ``chunk_bytes``: running bytes of all records; the record that reaches the
  limit opens a new chunk and the counter restarts at 0 without it (W2).

Records leave the tasks as Arrow batches of a bounded number of bytes.
"""
from __future__ import annotations

import io
import json
import os
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader,
                                    InputPartition)

from netlens.schema import CHUNK_BYTES
from netlens.session import cut_lineage
from netlens.sources.fs import file_sizes, list_times, open_input, publish, resolve

PCAP_SCHEMA = ("source string, chunk_id long, packet_no long, kept_no long, ts_us long, "
               "frame binary")
EXTENSIONS = (".pcap", ".cap", ".pcapng")


def list_captures(path: str) -> list[str]:
    """Capture files of a folder, or the file itself (local path or cluster URI)."""
    from netlens.sources.fs import list_files
    return list_files(path, EXTENSIONS)


PCAP_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", False), b"\xa1\xb2\xc3\xd4": (">", False),
              b"\x4d\x3c\xb2\xa1": ("<", True), b"\xa1\xb2\x3c\x4d": (">", True)}
SECTION = b"\x0a\x0d\x0d\x0a"
SPLIT_BYTES = 64 << 20
PEEK = 34                                        # payload bytes that the index looks at
BATCH_RECORDS, BATCH_BYTES = 4096, 4 << 20


@dataclass
class _Place:
    """Where a walk stands: all that reading on from byte ``at`` needs."""
    at: int = 0
    endian: str = "<"
    nano: bool = False
    section: bool = False                        # pcapng
    units: dict[int, int] = field(default_factory=dict)   # interface -> timestamp units a second
    chunk: int = 0
    acc: int = 0                                 # bytes in the chunk
    packets: int = 0
    kept: int = 0                                # kept records in the chunk

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "_Place":
        fields = json.loads(text)
        return cls(**fields | {"units": {int(k): v for k, v in fields["units"].items()}})


class _Walk:
    """The records of one capture from a place on; with ``peek`` only that many bytes of each."""

    def __init__(self, fh, size: int, place: _Place, peek: int | None = None):
        self.fh, self.size, self.place, self.peek = fh, size, place, peek
        fh.seek(place.at)

    @classmethod
    def start(cls, fh, size: int, peek: int | None = None) -> "_Walk | None":
        """At the first record; None if it is no capture."""
        head = fh.read(4)
        if head == SECTION:
            return cls(fh, size, _Place(0, section=True), peek)
        if head not in PCAP_MAGIC:
            return None
        endian, nano = PCAP_MAGIC[head]
        return cls(fh, size, _Place(24, endian, nano), peek)

    def _payload(self, length: int) -> bytes:
        return self.fh.read(length if self.peek is None else min(length, self.peek))

    def next(self) -> tuple[int, bytes, int] | None:
        """(ts_us, bytes, length) of the next record."""
        return self._next_block() if self.place.section else self._next_record()

    def _next_record(self):
        at = self.place
        head = self.fh.read(16)
        if len(head) < 16:
            return None
        sec, frac, length, _ = struct.unpack(at.endian + "IIII", head)
        if at.at + 16 + length > self.size:
            return None                          # truncated final record
        buf = self._payload(length)
        at.at += 16 + length
        if len(buf) < length:
            self.fh.seek(at.at)
        return sec * 1_000_000 + (frac // 1000 if at.nano else frac), buf, length

    def _next_block(self):
        at = self.place
        while True:
            head = self.fh.read(12)
            if len(head) < 12:
                return None
            if head[:4] == SECTION:              # the byte-order magic follows the length
                at.endian, at.units = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">", {}
            kind, total = struct.unpack(at.endian + "II", head[:8])
            if total < 12 or at.at + total > self.size:
                return None                      # truncated final block
            body, record = total - 8, None       # the body begins with the last 4 bytes of head
            if head[:4] == SECTION:
                pass
            elif kind == 1:                      # interface description
                at.units[len(at.units)] = _interface_units(head[8:] + self.fh.read(body - 4), at.endian)
            elif kind == 6:                      # enhanced packet
                fixed = head[8:] + self.fh.read(min(16, body - 4))
                if len(fixed) < 20:
                    return None
                iface, high, low, cap, _ = struct.unpack(at.endian + "IIIII", fixed)
                length = min(cap, body - 20)
                units = at.units.get(iface, 1_000_000)
                record = ((high << 32) | low) * 1_000_000 // units, self._payload(length), length
            elif kind == 3:                      # simple packet (no timestamp)
                length = max(0, min(struct.unpack(at.endian + "I", head[8:])[0], body - 8))
                record = 0, self._payload(length), length
            at.at += total
            self.fh.seek(at.at)
            if record:
                return record


def _interface_units(body: bytes, endian: str) -> int:
    """Timestamp units a second of an interface description."""
    units, options, i = 1_000_000, body[8:-4], 0
    while i + 4 <= len(options):
        code, length = struct.unpack(endian + "HH", options[i:i + 4])
        if code == 0:
            break
        if code == 9 and length >= 1:
            v = options[i + 4]
            units = 2 ** (v & 0x7F) if v & 0x80 else 10 ** v
        i += 4 + (length + 3) // 4 * 4
    return units


def _kept(buf: bytes, length: int) -> bool:
    """Same rule as the decode's ``keep``: IPv4 with a full header, or ARP."""
    if length < 14:
        return False
    et = (buf[12] << 8) | buf[13]
    return (et == 0x0800 and length >= 34) or et == 0x0806


@contextmanager
def _opened(path: str):
    """(buffered file, size)"""
    with open_input(path) as raw:
        size = raw.size()
        with io.BufferedReader(raw, 1 << 20) as fh:
            yield fh, size


def _counted(walk: _Walk, chunk_bytes: int, max_packets: int | None) -> Iterator[tuple]:
    """(kept_no, ts_us, bytes) of each record; the walk's place has the counters after it.

    ``kept_no`` is the 1-based position of a kept record inside its chunk
    (None for records the window path skips), so window ids need no sort."""
    at = walk.place
    while not (max_packets and at.packets >= max_packets) and (record := walk.next()):
        ts_us, buf, length = record
        at.packets += 1
        at.acc += length
        if at.acc >= chunk_bytes:
            at.chunk, at.acc, at.kept = at.chunk + 1, 0, 0
        kept = _kept(buf, length)
        at.kept += kept
        yield at.kept if kept else None, ts_us, buf


def read_capture(path: str, chunk_bytes: int = CHUNK_BYTES, max_packets: int | None = None,
                 begin: str | None = None, end: int | None = None) -> Iterator[tuple]:
    """Yield (source, chunk_id, packet_no, kept_no, ts_us, frame) for one file, or for the
    records of a split: from the place ``begin`` up to byte ``end``."""
    name = os.path.basename(path.rstrip("/"))
    with _opened(path) as (fh, size):
        walk = _Walk(fh, size, _Place.from_json(begin)) if begin else _Walk.start(fh, size)
        if walk is None or (end is not None and walk.place.at >= end):
            return
        at = walk.place
        for kept_no, ts_us, buf in _counted(walk, chunk_bytes, max_packets):
            yield name, at.chunk, at.packets, kept_no, ts_us, buf
            if end is not None and at.at >= end:
                return


def capture_splits(path: str, chunk_bytes: int, max_packets: int | None, split_bytes: int) -> Iterator[tuple[str, int]]:
    """(place, end byte) of the splits of one file, from its record headers."""
    with _opened(path) as (fh, size):
        walk = _Walk.start(fh, size, PEEK)
        if walk is None:
            return
        at = walk.place
        begin, first = at.to_json(), at.at
        for _ in _counted(walk, chunk_bytes, max_packets):
            if at.at - first >= split_bytes:
                yield begin, at.at
                begin, first = at.to_json(), at.at
        if at.at > first:
            yield begin, at.at


_ARROW = pa.schema([("source", pa.string()), ("chunk_id", pa.int64()), ("packet_no", pa.int64()),
                    ("kept_no", pa.int64()), ("ts_us", pa.int64()), ("frame", pa.binary())])


def _arrow(records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """The records in batches of a bounded number of rows and bytes."""
    rows, held = [], 0
    for r in records:
        rows.append(r)
        held += len(r[5])
        if len(rows) >= BATCH_RECORDS or held >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class PcapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        self.paths = json.loads(options.get("paths", "null"))     # exactly these files
        self.chunk_bytes = int(options.get("chunkBytes", CHUNK_BYTES))
        mp = options.get("maxPackets")
        self.max_packets = int(mp) if mp else None

    def partitions(self):
        files = self.paths if self.paths is not None else list_captures(self.path)
        if not files:
            raise FileNotFoundError(f"no capture files at {self.path}")
        return [_FilePartition(f) for f in files]

    def read(self, partition):
        yield from _arrow(read_capture(partition.path, self.chunk_bytes, self.max_packets))


class PcapStreamReader(DataSourceStreamReader):
    """Closed capture files of a folder, each read once (S9, ST1, ST3).

    The files met are kept in a log (``logPath``) that belongs to one stream: entry n
    holds the closed files that were new at the n-th look.  The offset is only n, so
    its size does not grow with the folder, and a file that lands late is read
    whatever its modification time is.  An entry is published under its number only
    if that is free, before the number is returned, so a replay reads the same files.
    Every ``COMPACT`` entries the files seen so far that are still in the folder are
    written as a snapshot: a start reads the last snapshot and the entries after it.

    The file written last may still be growing, so it is held back (``skipNewest``,
    default true) until a later one appears.  Any other file counts as closed; one
    whose modification time moves after that is read again.
    """

    COMPACT = 32

    def __init__(self, options: dict):
        self.base = PcapReader(options)
        self.skip_newest = str(options.get("skipNewest", "true")).lower() == "true"
        self.log_path = options["logPath"]
        self.seen: set[tuple[int, str]] | None = None    # what the log held at entry `at`
        self.at = 0

    def __getstate__(self):                           # tasks do not need the log
        return self.__dict__ | {"seen": None}

    def _file(self, kind: str, n: int) -> str:
        return f"{self.log_path}/{kind}-{n:012d}.json"

    def _read(self, kind: str, n: int) -> list[tuple[int, str]] | None:
        f, path = resolve(self._file(kind, n))
        if f.get_file_info(path).type != pafs.FileType.File:
            return None
        with open_input(self._file(kind, n)) as fh:
            return [(t, p) for t, p in json.loads(fh.read())]

    def _load(self) -> None:
        """What other looks, or an earlier run, have put into the log."""
        if self.seen is None:
            f, folder = resolve(self.log_path)
            f.create_dir(folder, recursive=True)
            names = [i.base_name for i in f.get_file_info(pafs.FileSelector(folder))]
            self.at = max((int(x[9:21]) for x in names if x.startswith("snapshot-") and x.endswith(".json")), default=0)
            self.seen = set(self._read("snapshot", self.at) or []) if self.at else set()
        while (entry := self._read("entry", self.at + 1)) is not None:
            self.seen |= set(entry)
            self.at += 1

    def initialOffset(self):
        return {"batch": 0}

    def latestOffset(self):
        self._load()
        files = list_times(self.base.path, EXTENSIONS)
        new = [x for x in (files[:-1] if self.skip_newest else files) if x not in self.seen]
        if new:
            publish(self._file("entry", self.at + 1), json.dumps(new).encode())
            self._load()                              # the entry, or that of a stream that was first
            if self.at % self.COMPACT == 0:
                self.seen &= set(files) | set(new)
                publish(self._file("snapshot", self.at), json.dumps(sorted(self.seen)).encode())
        return {"batch": self.at}

    def partitions(self, start, end):
        entries = [self._read("entry", n) for n in range(start["batch"] + 1, end["batch"] + 1)]
        if None in entries:
            raise FileNotFoundError(f"{self.log_path} lacks entries of {start['batch'] + 1} to {end['batch']}")
        return [_FilePartition(p) for p in dict.fromkeys(p for entry in entries for _, p in entry)]

    def read(self, partition):
        yield from _arrow(read_capture(partition.path, self.base.chunk_bytes, self.base.max_packets))

    def commit(self, end):
        pass


class PcapDataSource(DataSource):
    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return PCAP_SCHEMA

    def reader(self, schema):
        return PcapReader(self.options)

    def streamReader(self, schema):
        return PcapStreamReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(PcapDataSource)


def split_index(spark, files: list[str], chunk_bytes: int = CHUNK_BYTES, max_packets: int | None = None,
                split_bytes: int = SPLIT_BYTES):
    """(path, begin, stop): the captures' splits, a task a file, written to the shared folder."""
    def index(batches):
        for b in batches:
            for path in b["path"].to_pylist():
                found = list(capture_splits(path, chunk_bytes, max_packets, split_bytes))
                yield pa.record_batch([pa.array([path] * len(found), pa.string()), pa.array([f[0] for f in found], pa.string()),
                                       pa.array([f[1] for f in found], pa.int64())], names=["path", "begin", "stop"])

    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(len(files), "path")
    return cut_lineage(listed.mapInArrow(index, "path string, begin string, stop long"))


def read_splits(splits, chunk_bytes: int = CHUNK_BYTES, max_packets: int | None = None):
    """The records of the splits; as many tasks as splits."""
    def read(batches):
        for b in batches:
            for path, begin, stop in zip(*(b[c].to_pylist() for c in ("path", "begin", "stop"))):
                yield from _arrow(read_capture(path, chunk_bytes, max_packets, begin, stop))

    return splits.repartition(max(1, splits.count())).mapInArrow(read, PCAP_SCHEMA)


def read_packets(spark, path: str | list[str], chunk_bytes: int = CHUNK_BYTES,
                 max_packets: int | None = None, split_bytes: int = SPLIT_BYTES):
    """Capture folder, file or list of files -> raw records."""
    files = list_captures(path) if isinstance(path, str) else list(path)
    if any(size > split_bytes for size in file_sizes(files)):
        return read_splits(split_index(spark, files, chunk_bytes, max_packets, split_bytes), chunk_bytes, max_packets)
    register(spark)
    r = spark.read.format("pcap").option("chunkBytes", str(chunk_bytes))
    r = r.option("path", path) if isinstance(path, str) else r.option("paths", json.dumps(files))
    if max_packets:
        r = r.option("maxPackets", str(max_packets))
    return r.load()


def stream_captures(spark, path: str, log_path: str, chunk_bytes: int = CHUNK_BYTES, skip_newest: bool = True):
    """Closed capture files as a stream of raw records (S9, ST1).

    ``log_path``: a folder of this stream's own, beside its checkpoint, for the files it has met."""
    register(spark)
    return (spark.readStream.format("pcap").option("path", path).option("logPath", log_path)
                 .option("chunkBytes", str(chunk_bytes))
                 .option("skipNewest", str(skip_newest).lower()).load())


def decoded_packets(spark, path: str | list[str], **kw):
    """Capture file(s) -> decoded header columns, ready for the window path."""
    from netlens.functions.decode import decode_frames
    return decode_frames(read_packets(spark, path, **kw))
