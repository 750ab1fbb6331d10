"""File access from tasks through pyarrow.fs: local paths and cluster URIs
(hdfs://, s3://, gs://, file:) alike."""
from __future__ import annotations

import os
import uuid

from pyarrow import fs as pafs


def resolve(uri: str):
    """(filesystem, path) for a URI or a plain local path."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def open_input(uri: str):
    f, p = resolve(uri)
    return f.open_input_file(p)


def file_sizes(uris: list[str]) -> list[int]:
    """Bytes of each file (0 if it is not there), one request a file system."""
    if not uris:
        return []
    f, _ = resolve(uris[0])
    return [i.size or 0 for i in f.get_file_info([resolve(u)[1] for u in uris])]


def list_times(uri: str, extensions: tuple[str, ...]) -> list[tuple[int, str]]:
    """(modification time in ns, file) of a folder's files, oldest first."""
    out = []
    for name in list_files(uri, extensions):
        f, p = resolve(name)
        out.append((f.get_file_info(p).mtime_ns or 0, name))
    return sorted(out)


def list_files(uri: str, extensions: tuple[str, ...]) -> list[str]:
    """Sorted files under a folder (one level) with one of the extensions,
    or the file itself; URIs keep their scheme."""
    f, p = resolve(uri)
    info = f.get_file_info(p)
    if info.type == pafs.FileType.File:
        return [uri]
    if info.type != pafs.FileType.Directory:
        return []
    prefix = uri[: len(uri) - len(p)] if "://" in uri and uri.endswith(p) else ""
    out = [prefix + i.path for i in f.get_file_info(pafs.FileSelector(p))
           if i.type == pafs.FileType.File and i.path.lower().endswith(extensions)]
    return sorted(out)


def publish(uri: str, data: bytes) -> bool:
    """Write a whole file under a name that is free; False, and nothing changed, if it is taken.

    A local name is claimed atomically by a hard link.  Elsewhere the name is looked
    up right before the move, so two writers there must not share a folder."""
    f, path = resolve(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with f.open_output_stream(part) as out:
        out.write(data)
    try:
        if isinstance(f, pafs.LocalFileSystem):
            os.link(part, path)
            return True
        if f.get_file_info(path).type != pafs.FileType.NotFound:
            return False
        f.copy_file(part, path)
        return True
    except FileExistsError:
        return False
    finally:
        f.delete_file(part)
