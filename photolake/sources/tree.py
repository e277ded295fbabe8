"""File trees as a Spark data source, for batches and streams: format "media_tree"."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from photolake.functions.paths import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS
from photolake.schemas import LISTING
from photolake.session import use_package

KNOWN = tuple(IMAGE_EXTENSIONS + VIDEO_EXTENSIONS)
COLUMNS = pa.schema([("root_id", pa.int64()), ("relative_path", pa.string()), ("file_size", pa.int64()), ("file_mtime", pa.float64())])
#: Rows of a batch that a task hands on.
ROWS = 10_000


@dataclass
class Folder(InputPartition):
    """A folder of a root, read with all that lies below it or by its own files alone."""

    relative: str
    below: bool
    after: int = -1  # changed later than this, in nanoseconds
    until: int = 1 << 62


def folders(root: str, depth: int) -> list[Folder]:
    """The folders down to a depth, each by its own files, and those at that depth with all below. Hidden ones are left out."""
    out, level = [], [""]
    for _ in range(depth):
        out += [Folder(x, False) for x in level]
        level = [os.path.join(x, e.name) for x in level for e in os.scandir(os.path.join(root, x)) if e.is_dir() and not e.name.startswith(".")]
    return out + [Folder(x, True) for x in level]


def files(root: str, root_id: int, part: Folder) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for where, dirs, names in os.walk(os.path.join(root, part.relative)):
        dirs[:] = [d for d in dirs if part.below and not d.startswith(".")]
        for name in names:
            if name.startswith(".") or not name.lower().endswith(KNOWN):
                continue
            try:
                st = os.stat(full := os.path.join(where, name))
            except FileNotFoundError:  # gone since the folder was read
                continue
            if part.after < st.st_ctime_ns <= part.until:
                rows.append((root_id, os.path.relpath(full, root), st.st_size, st.st_mtime))
        while len(rows) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[:ROWS], strict=True), COLUMNS.types, strict=True)], schema=COLUMNS)
            del rows[:ROWS]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), COLUMNS.types, strict=True)], schema=COLUMNS)


class _Options:
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("media_tree needs a path")
        self.root = options["path"].removeprefix("file://").removeprefix("file:")
        self.root_id, self.depth = int(options.get("root_id", 0)), int(options.get("depth", 2))
        self.settle_ns = int(options.get("settle_ms", 1000)) * 1_000_000


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = _Options(options)

    def partitions(self) -> list[Folder]:
        return folders(self.o.root, self.o.depth)

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return files(self.o.root, self.o.root_id, partition)


class TreeStream(DataSourceStreamReader):
    """Offsets are times: a batch has the files that were made, moved or written between two of them, by their change time."""

    def __init__(self, options: dict):
        self.o = _Options(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": time.time_ns() - self.o.settle_ns}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return [Folder(x.relative, x.below, start["until"], end["until"]) for x in folders(self.o.root, self.o.depth)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return files(self.o.root, self.o.root_id, partition)

    def commit(self, end: dict) -> None:
        pass


class MediaTree(DataSource):
    """S1. Media files under a path that driver and executors have mounted: root_id, relative_path, file_size, file_mtime.

    Hidden names are left out, names that begin with an underscore aren't.
    Options: path; root_id; depth, down to which every folder is a partition of
    its own, with all below it at that depth (the driver reads folders only down
    to it); settle_ms, for streams: how old a change must be to be told.
    """

    @classmethod
    def name(cls) -> str:
        return "media_tree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return TreeStream(self.options)


def register_tree(spark: SparkSession) -> None:
    """Makes spark.read.format("media_tree") and spark.readStream.format("media_tree") known."""
    use_package(spark)
    spark.dataSource.register(MediaTree)
