"""Growing line files as a stream (S8, ST4): a byte-offset tailing Python DataSource.

``spark.readStream.format("tail").load(path)`` follows the files of a folder, a
pattern or one file while they are written, one row per whole line (``value``):

* a file goes on where the last batch ended, at the byte after its last whole line;
  a half-written last line waits until its line end is there;
* the offset has, per file that is there, the bytes read and a fingerprint of them
  (a hash of the first ``HEAD`` and of the last ``TAIL`` of these bytes).  A file
  that is shorter, or whose bytes differ, is another file under an old name
  (truncated or replaced) and is read from its start;
* a file under a new name whose bytes are those of an entry that its old name no
  longer holds is that file, renamed by rotation: it goes on where it was;
* what a batch reads is found from its two offsets and the files' bytes alone, so a
  replay after a restart reads the same lines; a file that has gone since then
  raises, rather than being skipped.

Large backlogs are cut into ranges of ``splitBytes``, one task each: a range reads
the lines that start in it.  The driver reads file heads and tails only, and those
only of files whose size or time has changed.  The offset grows with the number of
files that are there, so rotation should delete or move old ones.

Limits: a file moved out of the watched path with unread lines is not followed; a
copy beside its original counts as a file of its own (its lines are rows again).
"""
from __future__ import annotations

import fnmatch
import hashlib
import json
import re

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from netlens.sources.fs import open_input, resolve

HEAD, TAIL = 1024, 256
SPLIT_BYTES = 64 << 20
_BLOCK = 1 << 16
_SKIPPED = (".crc", ".gz", ".part", ".tmp")
_WILD = re.compile(r"[*?\[]")


def line_files(uri: str) -> list[tuple[str, int, int]]:
    """(file, size, modification time) of a file, a folder's files or a pattern's."""
    f, p = resolve(uri)
    prefix = uri[: len(uri) - len(p)] if "://" in uri and uri.endswith(p) else ""
    parts = p.rstrip("/").split("/")
    wild = next((i for i, x in enumerate(parts) if _WILD.search(x)), len(parts))
    base, pattern = "/".join(parts[:wild]) or "/", parts[wild:]
    info = f.get_file_info(base)
    if info.type == pafs.FileType.File:
        found = [info] if not pattern else []
    elif info.type == pafs.FileType.Directory:
        found = f.get_file_info(pafs.FileSelector(base, recursive=bool(pattern)))
    else:
        return []

    def matches(x) -> bool:
        inside = x.path[len(base.rstrip("/")) + 1:].split("/") if x.path != base else []
        if inside and (inside[-1].startswith((".", "_")) or inside[-1].endswith(_SKIPPED)):
            return False
        # the pattern names the file itself or the folder it lies in
        return not pattern or (len(inside) - len(pattern) in (0, 1)
                               and all(fnmatch.fnmatchcase(a, b) for a, b in zip(inside, pattern)))

    return sorted((prefix + x.path, x.size, x.mtime_ns or 0) for x in found
                  if x.type == pafs.FileType.File and matches(x))


def _hash(fh, start: int, length: int) -> str:
    fh.seek(start)
    return hashlib.md5(fh.read(length), usedforsecurity=False).hexdigest()


def fingerprint(fh, upto: int) -> list:
    """[bytes, hash of the first of them, hash of the last of them]."""
    return [upto, _hash(fh, 0, min(upto, HEAD)), _hash(fh, max(0, upto - TAIL), min(upto, TAIL))]


def holds(fh, size: int, entry: list) -> bool:
    """Whether the file still begins with the bytes of the entry."""
    return size >= entry[0] and fingerprint(fh, entry[0]) == entry


def whole_lines(fh, size: int) -> int:
    """The byte after the last line end."""
    at = size
    while at > 0:
        start = max(0, at - _BLOCK)
        fh.seek(start)
        end = fh.read(at - start).rfind(b"\n")
        if end >= 0:
            return start + end + 1
        at = start
    return 0


def continued(start: dict, path: str, fh, size: int, held: set[str]) -> int:
    """The byte at which the file goes on: what ``start`` says of it under this name, or
    under another one that it no longer has (those in ``held`` still have theirs)."""
    if path in start and holds(fh, size, start[path]):
        return start[path][0]
    return max((e[0] for name, e in start.items() if name != path and name not in held and holds(fh, size, e)), default=0)


def ranges(path: str, start: int, end: int, split: int) -> list[tuple[str, int, int, int]]:
    """(file, begin, stop, from): the lines that start in begin .. stop, of those from byte ``from`` on."""
    return [(path, a, min(end, a + split), start) for a in range(start, end, split)]


def read_lines(path: str, begin: int, stop: int, first: int):
    """The lines that start in begin .. stop; ``first`` is where a line is known to start."""
    with open_input(path) as fh:
        at, rest = begin, b""
        if begin > first:                             # the line over the edge belongs to the range before
            fh.seek(begin - 1)
            at = begin - 1
            skipping = True
        else:
            fh.seek(begin)
            skipping = False
        while at < stop or rest:
            block = fh.read(_BLOCK)
            if not block:
                return                                # nothing after the last whole line
            pieces = (rest + block).split(b"\n")
            line_at = at - len(rest)
            for piece in pieces[:-1]:
                begins, line_at = line_at, line_at + len(piece) + 1
                if skipping:
                    skipping = False
                elif begins >= stop:
                    return
                else:
                    yield piece.removesuffix(b"\r").decode("utf-8", "replace")
            at, rest = at + len(block), pieces[-1]
            if line_at >= stop and not skipping:
                return


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, stop: int, first: int):
        super().__init__((path, begin, stop, first))


class _Lines:
    def read(self, partition):
        for line in read_lines(*partition.value):
            yield (line,)


class TailReader(_Lines, DataSourceReader):
    """The whole lines there are now (batch)."""

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self):
        out = []
        for path, size, _ in line_files(self.path):
            with open_input(path) as fh:
                out += ranges(path, 0, whole_lines(fh, size), self.split)
        return [_Range(*r) for r in out] or [_Range(self.path, 0, 0, 0)]


class TailStreamReader(_Lines, DataSourceStreamReader):
    """Offsets are {"files": {path: fingerprint}}."""

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.known: dict[str, tuple] = {}             # path -> (size, time, entry): unchanged files are not opened

    def initialOffset(self):
        return {"files": "{}"}

    def latestOffset(self):
        known = {}
        for path, size, time in line_files(self.path):
            if path in self.known and self.known[path][:2] == (size, time):
                known[path] = self.known[path]
                continue
            with open_input(path) as fh:
                known[path] = size, time, fingerprint(fh, whole_lines(fh, size))
        self.known = known
        return {"files": json.dumps({p: e for p, (_, _, e) in sorted(known.items()) if e[0]})}

    def partitions(self, start, end):
        before, after = json.loads(start["files"]), json.loads(end["files"])
        sizes = {p: size for p, size, _ in line_files(self.path)}

        def has(path: str, entry: list) -> bool:
            if path not in sizes:
                return False
            with open_input(path) as fh:
                return holds(fh, sizes[path], entry)

        changed = {p: e for p, e in after.items() if before.get(p) != e}
        # names whose files are still those of the batch's start
        held = {p for p, e in before.items() if after.get(p) == e or (p in after and after[p][0] >= e[0] and has(p, e))}
        out = []
        for path, entry in changed.items():
            # the file may have been renamed since the offset was taken
            now = path if has(path, entry) else next((p for p in sizes if p not in after and has(p, entry)), None) \
                or next((p for p in sizes if has(p, entry)), None)
            if now is None:
                raise FileNotFoundError(f"{path}, or its first {entry[0]} bytes, are no longer there")
            with open_input(now) as fh:
                first = continued(before, path, fh, entry[0], held)
            out += ranges(now, first, entry[0], self.split)
        return [_Range(*r) for r in out]

    def commit(self, end):
        pass

    def __getstate__(self):                           # tasks do not need what the driver knows
        return self.__dict__ | {"known": {}}


class TailDataSource(DataSource):
    @classmethod
    def name(cls):
        return "tail"

    def schema(self):
        return "value string"

    def reader(self, schema):
        return TailReader(self.options)

    def streamReader(self, schema):
        return TailStreamReader(self.options)


def stream_lines(spark, path: str, split_bytes: int = SPLIT_BYTES):
    """The whole lines of growing files, each once, as a stream."""
    spark.dataSource.register(TailDataSource)
    return spark.readStream.format("tail").option("path", path).option("splitBytes", str(split_bytes)).load()
