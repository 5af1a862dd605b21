"""Byte access to files of any store that Arrow knows: ranged reads, re-openable ranges, and uploads in parts.

An upload collects numbered parts in any order, from any task, and puts them together at its end; one that isn't finished leaves nothing behind.
Stores that only Spark reads (others than ``KNOWN_SCHEMES``) can be read through ``binaryFile``, whole files up to 2 GB at a time.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

KNOWN_SCHEMES = ("", "file", "s3", "s3a", "gs", "hdfs")
# Fixed value: the most parts that a multipart upload may have.
MAX_PARTS = 10_000
COPY_BYTES = 8 << 20


class StoreError(ValueError):
    """A range, a part or an upload that can't be."""


def scheme(path: str) -> str:
    m = re.match(r"^([a-zA-Z][a-zA-Z0-9+.-]*):/", path)
    return m[1].lower() if m else ""


def file_system(path: str):
    """(file system, path within it) of a URI or a local path."""
    from pyarrow import fs

    path = re.sub(r"^s3[an]://", "s3://", path)
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(re.sub(r"^file:/*", "/", path))
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def opened(path: str):
    """An open file with ``read_at`` and ``size``."""
    system, inner = file_system(path)
    return system.open_input_file(inner)


def read_range(path: str, start: int, n: int) -> bytes:
    """``n`` bytes from ``start``; a negative start counts from the end. A range that isn't wholly inside is an error."""
    with opened(path) as f:
        at = f.size() + start if start < 0 else start
        if at < 0 or n < 0 or at + n > f.size():
            raise StoreError(f"{path}: bytes {at} to {at + n} lie beyond the end of {f.size()}")
        return f.read_at(n, at)


@dataclass(frozen=True)
class Range:
    """A stretch of a file that can be opened again and again, each time from its beginning."""

    path: str
    start: int
    length: int

    def open(self) -> io.BufferedReader:
        return io.BufferedReader(_RangeReader(self))

    def read(self) -> bytes:
        return read_range(self.path, self.start, self.length)


class _RangeReader(io.RawIOBase):
    def __init__(self, span: Range):
        self.span, self.at, self.file = span, 0, opened(span.path)
        if span.start < 0 or span.length < 0 or span.start + span.length > self.file.size():
            size = self.file.size()
            self.file.close()
            raise StoreError(f"{span.path}: bytes {span.start} to {span.start + span.length} of {size}")

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        n = min(len(into), self.span.length - self.at)
        into[:n] = self.file.read_at(n, self.span.start + self.at)
        self.at += n
        return n

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()


class Upload:
    """An object written in numbered parts (from 1). As a context it aborts unless it was finished.

    Parts may come in any order and from other processes (``put_part`` with the same ``id``); a part put again replaces the first.
    ``hooks`` are called before requests: ``start(target)``, ``part(target, number, size)``, ``finish(target, numbers)``, ``abort(target)``.
    """

    def __init__(self, target: str, *, upload: str | None = None, hooks: dict[str, Callable] | None = None):
        self.target, self.id, self.hooks = target, upload or uuid.uuid4().hex, hooks or {}
        self.numbers: set[int] = set()
        self.given = 0
        self.state = "open"
        if upload is None:
            self._call("start")

    def _call(self, name: str, *details) -> None:
        if name in self.hooks:
            self.hooks[name](self.target, *details)

    @property
    def folder(self) -> str:
        return f"{self.target}.parts-{self.id}"

    def next_part(self) -> int:
        """The next free part number; more than a store takes is an error."""
        self._require_open()
        if self.given >= MAX_PARTS:
            raise StoreError(f"an upload has at most {MAX_PARTS} parts")
        self.given += 1
        return self.given

    def put_part(self, number: int, data: bytes) -> int:
        """Store one part; returns its size."""
        self._require_open()
        if not 1 <= number <= MAX_PARTS:
            raise StoreError(f"part {number}: parts are numbered from 1 to {MAX_PARTS}")
        self._call("part", number, len(data))
        system, inner = file_system(self.folder)
        system.create_dir(inner, recursive=True)
        # Under a name of its own first: two attempts at one part never mix.
        with system.open_output_stream(written := f"{inner}/.{number}-{uuid.uuid4().hex}") as f:
            f.write(data)
        system.move(written, f"{inner}/{number}")
        self.numbers.add(number)
        return len(data)

    def known(self, numbers) -> Upload:
        """Parts that other processes have put."""
        self.numbers.update(numbers)
        return self

    def finish(self) -> int:
        """Put the parts together in order of number; returns the object's size."""
        self._require_open()
        if not self.numbers:
            raise StoreError("an upload without parts can't be finished")
        order = sorted(self.numbers)
        self._call("finish", order)
        system, inner = file_system(self.folder)
        _, target = file_system(self.target)
        size = 0
        with system.open_output_stream(f"{inner}/whole") as out:
            for n in order:
                with system.open_input_stream(f"{inner}/{n}") as part:
                    while piece := part.read(COPY_BYTES):
                        out.write(piece)
                        size += len(piece)
        system.move(f"{inner}/whole", target)
        system.delete_dir(inner)
        self.state = "finished"
        return size

    def abort(self) -> None:
        """Drop all parts; an upload that is over is left as it is."""
        if self.state != "open":
            return
        self._call("abort")
        from pyarrow import fs

        system, inner = file_system(self.folder)
        if system.get_file_info(inner).type == fs.FileType.Directory:
            system.delete_dir(inner)
        self.state = "aborted"

    def _require_open(self) -> None:
        if self.state != "open":
            raise StoreError(f"the upload is {self.state}")

    def __enter__(self) -> Upload:
        return self

    def __exit__(self, *failed) -> None:
        self.abort()


def delete_files(paths) -> None:
    """Delete those files that are there."""
    from pyarrow import fs

    for p in paths:
        system, inner = file_system(p)
        if system.get_file_info(inner).type == fs.FileType.File:
            system.delete_file(inner)
