"""Listings of file trees."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from photolake.functions.paths import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS
from photolake.schemas import LISTING
from photolake.session import use_package


def list_media(spark: SparkSession, roots: DataFrame) -> DataFrame:
    """S1. root_id, relative_path, size and time of the media files under roots (root_id, path), walked by the tasks.

    Hidden names are skipped, names that begin with an underscore are not
    (Spark's own file sources leave those out). Each top-level directory is a
    row of its own, so that one deep root is walked in parallel. The folders
    must be mounted on the executors; for object stores filter_media() works on
    an inventory table.
    """
    use_package(spark)
    known = tuple(IMAGE_EXTENSIONS + VIDEO_EXTENSIONS)

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, p, e.name, e.is_dir()) for i, p in zip(b.root_id, b.path, strict=True) if os.path.isdir(p) for e in os.scandir(p) if not e.name.startswith(".")]
            yield pd.DataFrame(out, columns=["root_id", "path", "name", "is_dir"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, root, name, is_dir in zip(b.root_id, b.path, b.name, b.is_dir, strict=True):
                out = []
                for where, dirs, files in os.walk(os.path.join(root, name)) if is_dir else [(root, [], [name])]:
                    dirs[:] = [d for d in dirs if not d.startswith(".")]
                    for f in files:
                        if not f.startswith(".") and f.lower().endswith(known):
                            st = os.stat(full := os.path.join(where, f))
                            out.append((i, os.path.relpath(full, root), st.st_size, st.st_mtime))
                if out:
                    yield pd.DataFrame(out, columns=["root_id", "relative_path", "file_size", "file_mtime"])

    top = roots.select("root_id", "path").mapInPandas(tops, "root_id long, path string, name string, is_dir boolean")
    return top.repartition("root_id", "name").mapInPandas(walk, LISTING)
