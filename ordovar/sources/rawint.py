"""Header-less files of native 32-bit integers, as a data source: spark.read.format("rawint32").

Reading splits files by byte ranges. Writing makes one file a partition under a hidden name; the commit gives them their names, so the
files in order of their names hold the rows in order of the partitions: appended parts come after those that are there, overwriting takes the
place of all of them, and a write that fails leaves what was there. Paths are on any file system that pyarrow opens by its URI, a local
path by default.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SPLIT_BYTES = 64 << 20


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int, first: int):
        self.path, self.begin, self.end, self.first = path, begin, end, first


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the parts of a folder, or of one file, in order."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(".bin") and not f.base_name.startswith("."))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES)) // 4 * 4

    def partitions(self) -> list[_Range]:
        out, first = [], 0
        for f, size in files(self.path):
            if size % 4:
                raise ValueError(f"{f} is not a whole number of 32-bit integers")
            out += [_Range(f, a, min(size, a + self.split), first + a // 4) for a in range(0, size, self.split)]
            first += size // 4
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as f:
            f.seek(partition.begin)
            at, left = partition.first, partition.end - partition.begin
            while left:
                data = f.read(min(left, 4 << 20))
                v = np.frombuffer(data, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(v))), pa.array(v)], ["pos", "value"])
                at, left = at + len(v), left - len(data)


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    path: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        task = TaskContext.get()
        path = f"{folder}/.{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}"
        with system.open_output_stream(path) as f:
            for b in batches:
                value = b.column(b.num_columns - 1)
                if value.null_count:
                    raise ValueError("a raw file holds no nulls")
                f.write(np.ascontiguousarray(value.cast(pa.int32()).to_numpy(zero_copy_only=False)).tobytes())
        return _Part(task.partitionId(), path)

    def commit(self, messages: list[_Part | None]) -> None:
        system, folder = opened(self.path)
        old = files(self.path)
        first = 0
        if not self.overwrite and old:
            numbers = [int(m[1]) for f, _ in old if (m := re.search(r"part-(\d+)\.bin$", f))]
            first = max(numbers, default=-1) + 1
        parts = sorted((m for m in messages if m), key=lambda m: m.partition)
        for i, m in enumerate(parts):  # the new parts are whole before the old ones go
            system.move(m.path, f"{folder}/{'.new-' if self.overwrite else ''}part-{first + i:06d}.bin")
        if self.overwrite:
            for f, _ in old:
                system.delete_file(f)
            for i in range(len(parts)):
                system.move(f"{folder}/.new-part-{i:06d}.bin", f"{folder}/part-{i:06d}.bin")
        self._clean(system, folder)

    def abort(self, messages: list[_Part | None]) -> None:
        self._clean(*opened(self.path))

    def _clean(self, system: fs.FileSystem, folder: str) -> None:
        for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.startswith(f".{self.job}-"):
                system.delete_file(f.path)


class RawInt32(DataSource):
    """Columns pos (place in all files) and value; writing takes the last column."""

    @classmethod
    def name(cls) -> str:
        return "rawint32"

    def schema(self) -> str:
        return "pos long, value int"

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:  # noqa: ANN001
        return _Writer(self.options, overwrite)
