"""Exact duplicates by content hash. A null or empty hash is in no group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.operators.ranks import rank_within


def _hashed(photos: DataFrame) -> DataFrame:
    return photos.filter("not missing and sha256 is not null and sha256 <> ''")


def duplicate_counts(photos: DataFrame) -> DataFrame:
    """A1. sha256, n of present rows, n > 1."""
    return _hashed(photos).groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def duplicate_group(photos: DataFrame, ids: DataFrame) -> DataFrame:
    """A2. All present members of the groups that the given ids are in, themselves included."""
    keys = _hashed(photos).join(ids.select("id"), "id", "left_semi").select("sha256").distinct()
    return _hashed(photos).join(keys, "sha256", "left_semi").select(*photos.columns)


def representatives(photos: DataFrame) -> DataFrame:
    """A3. sha256, id: the lowest id that isn't rejected, else the lowest."""
    best = F.min(F.struct((F.col("status") == "rejected").alias("rejected"), F.col("id")))
    return _hashed(photos).groupBy("sha256").agg(best.alias("m"), F.count(F.lit(1)).alias("n")).select("sha256", F.col("m.id").alias("id"), "n")


def redundant_copies(photos: DataFrame) -> DataFrame:
    """A4. id, sha256 of members that aren't their group's representative. Aggregated first, so a hot hash is no single task."""
    best = representatives(photos).filter("n > 1").select("sha256", F.col("id").alias("keep"))
    return _hashed(photos).select("id", "sha256").join(best, "sha256").filter("id <> keep").select("id", "sha256")


def redundant_copies_by_rank(photos: DataFrame) -> DataFrame:
    """A4 by rank: all but the first of each hash, ranked over range partitions, so that a hot hash is spread over tasks."""
    rows = _hashed(photos).select("id", "sha256", (F.col("status") == "rejected").alias("_rejected"))
    return rank_within(rows, ["sha256"], ["_rejected", "id"], "_n").filter("_n > 0").select("id", "sha256")
