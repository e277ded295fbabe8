"""Content hashes and perceptual hashes."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photolake.operators.ranks import running_sum
from photolake.session import stash, use_package

HEAD_BYTES = 65536
SIDE, LOW = 32, 8


def content_key(content: Column, size: Column) -> Column:
    """H2. A cheap key: SHA-1 of the first 64 KB and the size in decimal."""
    return F.sha1(F.concat(F.substring(content, 1, HEAD_BYTES), size.cast("string").cast("binary")))


def preview_key() -> Column:
    """H2. The content hash if known, else the cheap key."""
    return F.coalesce("sha256", "content_key")


def hash_pending(photos: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H1. (id and sha256 of local, present rows without a hash; error rows for files that are gone).

    files: relative_path, content (binary). Never limited to a date range.
    """
    pending = photos.filter("source = 'local' and not missing and sha256 is null").select("id", "relative_path")
    joined = pending.join(files.select("relative_path", F.sha2("content", 256).alias("sha256")), "relative_path", "left")
    done = joined.filter("sha256 is not null").select("id", "sha256")
    return done, joined.filter("sha256 is null").select("id", "relative_path", F.lit("file not found").alias("error"))


def share_out(paths: DataFrame, tasks: int) -> DataFrame:
    """Files (abs_path, file_size) with a `task` each, of which all get about as many bytes.

    Files of more than half a task's share are at most 2 * tasks: the driver
    deals them out, largest first, to the task with least. The others fill the
    tasks up by their running sum, so no task gets more than half a share above
    its own, unless one file is larger than that.
    """
    sized = paths.select("abs_path", F.greatest(F.coalesce("file_size", F.lit(0)), F.lit(1)).cast("long").alias("file_size"))
    total = sized.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]
    half = total / tasks / 2
    large = sorted(((r.file_size, r.abs_path) for r in sized.filter(F.col("file_size") > half).collect()), reverse=True)
    loads, dealt = [(0, t) for t in range(tasks)], []
    for size, path in large:
        load, t = heapq.heappop(loads)
        dealt.append((path, size, t))
        heapq.heappush(loads, (load + size, t))
    filled = np.array([load for load, _ in sorted(loads, key=lambda x: x[1])], float)
    low, high = 0.0, float(total) + 1
    rest = total - filled.sum()
    for _ in range(100):  # the level up to which the small files fill all tasks
        level = (low + high) / 2
        low, high = (level, high) if np.maximum(level - filled, 0).sum() < rest else (low, level)
    ends = np.cumsum(np.maximum(high - filled, 0))
    at = np.searchsorted

    @F.pandas_udf("int")
    def task_of(begin: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(at(ends, begin.to_numpy(float), side="right"), tasks - 1).astype(np.int32))

    small = running_sum(sized.filter(F.col("file_size") <= half), ["abs_path"], "file_size", "_begin")
    out = small.select("abs_path", "file_size", task_of("_begin").alias("task"))
    return out.unionByName(paths.sparkSession.createDataFrame(dealt, "abs_path string, file_size long, task int"))


def hash_by_size(paths: DataFrame, tasks: int | None = None, chunk: int = 1 << 22) -> DataFrame:
    """H1 for files (abs_path, file_size): abs_path, sha256 or error, read in chunks, so that files of any size do.

    Each task reads about as many bytes. Executors must be able to open the paths.
    """
    spark = paths.sparkSession
    use_package(spark)
    tasks = tasks or spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b.abs_path:
                h = hashlib.sha256()
                try:
                    with open(p, "rb") as f:
                        while data := f.read(chunk):
                            h.update(data)
                    out.append((p, h.hexdigest(), None))
                except OSError as e:
                    out.append((p, None, type(e).__name__))
            yield pd.DataFrame(out, columns=["abs_path", "sha256", "error"])

    shared = stash(share_out(paths, tasks), "shared")
    return shared.repartitionById(tasks, "task").select("abs_path").mapInPandas(run, "abs_path string, sha256 string, error string")


def hash_large_files(paths: DataFrame, chunk: int = 1 << 22) -> DataFrame:
    """H1 for files whose sizes aren't known: abs_path, sha256 or error."""
    return hash_by_size(paths.select("abs_path", F.lit(1).alias("file_size")), chunk=chunk)


def dct_basis(n: int = SIDE) -> np.ndarray:
    """Rows of the type-II cosine transform."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return 2 * np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def phash64(gray: Column) -> Column:
    """H3. 16 hex digits from 32 x 32 luminance values (an array of 1024): which low frequencies exceed their median. Null for any other length."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        basis = dct_basis()[:LOW]
        good = [v is not None and len(v) == SIDE * SIDE for v in values]
        out = np.full(len(values), None, object)
        if any(good):
            image = np.stack([np.asarray(v, float) for v, g in zip(values, good, strict=True) if g]).reshape(-1, SIDE, SIDE)
            low = np.einsum("kx,nxy,ly->nkl", basis, image, basis).reshape(-1, LOW * LOW)
            bits = low > np.median(low, axis=1, keepdims=True)
            out[np.flatnonzero(good)] = [p.tobytes().hex() for p in np.packbits(bits, axis=1)]
        return pd.Series(out)

    return run(gray)


def phash_bits(phash: Column) -> Column:
    """The hash as a long; null unless it is 16 hex digits."""
    return F.when(phash.rlike("^[0-9a-fA-F]{16}$"), F.conv(phash, 16, -10).cast("long"))


def phash_worklist(photos: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """H3. Hashed local images in the working range that have no perceptual hash yet."""
    from photolake.functions.dates import in_range

    return photos.filter("source = 'local' and not missing and media_type = 'image' and sha256 is not null and phash is null").filter(in_range(F.col("captured_at"), start, end))
