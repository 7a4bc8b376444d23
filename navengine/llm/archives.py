"""Byte-level access to archives in any store that pyarrow reads, for tasks on executors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa

from .common import filesystem

MANIFEST = "path string, bytes bigint, records bigint"


@contextmanager
def reading(uri: str):
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        yield f


class ArchiveWriter:
    """Writes a task's records into archives of about ``most`` bytes with names of their own.

    A task that runs again writes new files; only the attempt whose rows Spark keeps is in the manifest.
    """

    def __init__(self, folder: str, suffix: str, most: int, close: Callable | None = None):
        self.folder, self.suffix, self.most, self.close = folder, suffix, most, close
        self.fs, self.path = filesystem(folder)
        self.out, self.done = None, []

    def open(self):
        if self.out is None:
            self.fs.create_dir(self.path, recursive=True)
            self.name = f"{uuid.uuid4().hex}{self.suffix}"
            self.out, self.bytes, self.records = self.fs.open_output_stream(f"{self.path}/{self.name}"), 0, 0
        return self.out

    def add(self, data: bytes) -> int:
        """Appends a record; its offset."""
        self.open().write(data)
        at, self.bytes, self.records = self.bytes, self.bytes + len(data), self.records + 1
        if self.bytes >= self.most:
            self.roll()
        return at

    def roll(self) -> None:
        if self.out is not None:
            if self.close:
                self.bytes += self.close(self)
            self.out.close()
            self.done.append((f"{self.folder}/{self.name}", self.bytes, self.records))
            self.out = None

    def manifest(self) -> pa.RecordBatch:
        self.roll()
        cols = list(zip(*self.done, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "bytes", "records"])


def written(batches: Iterator[pa.RecordBatch], record: Callable[..., bytes], folder: str, suffix: str, most: int) -> Iterator[pa.RecordBatch]:
    """Writes ``record(*values)`` of every row; yields the manifest of the task's archives."""
    w = ArchiveWriter(folder, suffix, most)
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            w.add(record(*row))
    yield w.manifest()
