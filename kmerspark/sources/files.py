"""Opening files of any store that pyarrow knows, plain or gzipped, one stream at a time."""

from __future__ import annotations

import fnmatch
import gzip
import io
import os
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import pyarrow.fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(uri).path if scheme else uri
    return pafs.FileSystem.from_uri(uri)


def list_files(paths: list[str]) -> list[tuple[str, int]]:
    """(uri, size) of every file: of a folder, the visible files in it; of a pattern with * or ?, those that match."""
    out = []
    for p in paths:
        fs, path = filesystem(p)
        prefix = p[: len(p) - len(path)] if p.endswith(path) else ""
        if any(c in os.path.basename(path) for c in "*?["):
            infos = [i for i in fs.get_file_info(pafs.FileSelector(os.path.dirname(path))) if fnmatch.fnmatch(i.base_name, os.path.basename(path))]
        else:
            info = fs.get_file_info(path)
            if info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(p)
            infos = fs.get_file_info(pafs.FileSelector(path)) if info.type == pafs.FileType.Directory else [info]
        # what is neither file nor folder is a pipe
        out += sorted((prefix + i.path, i.size or 0) for i in infos if i.type in (pafs.FileType.File, pafs.FileType.Unknown) and not i.base_name.startswith((".", "_")))
    return out


@contextmanager
def open_stream(uri: str, offset: int = 0) -> Iterator[io.BufferedReader]:
    """Buffered bytes from ``offset`` on; gzip members (also blocked gzip) are unpacked."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem) and not os.path.isfile(path):  # a pipe can't be read from any place but its start
        with open(path, "rb") as pipe:
            yield io.BufferedReader(gzip.GzipFile(fileobj=pipe), 1 << 20) if pipe.peek(2)[:2] == b"\x1f\x8b" else pipe
        return
    raw = fs.open_input_file(path)
    try:
        magic = raw.read(2)
        raw.seek(offset)
        if magic == b"\x1f\x8b":
            yield io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)
        else:
            yield io.BufferedReader(_Raw(raw), 1 << 20)
    finally:
        raw.close()


class _Raw(io.RawIOBase):
    def __init__(self, f) -> None:
        self.f = f

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.f.read(len(b))
        b[: len(data)] = data
        return len(data)
