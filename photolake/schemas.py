"""Schemas of the catalog's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHOTOS = (
    "id long not null, relative_path string not null, status string, original_path string, provenance string, "
    "file_size long, file_mtime double, sha256 string, phash string, captured_at timestamp, captured_at_source string, "
    "media_type string, live_photo_video_path string, missing boolean, status_changed_at timestamp, indexed_at timestamp, "
    "source string, account string, remote_id string, remote_filename string, source_ref long"
)
PAIRS = "photo_a long, photo_b long, hamming_distance short, resolved boolean"
SOURCES = "id long, kind string, name string, path string, account string, added_at timestamp"
LISTING = "root_id long, relative_path string, file_size long, file_mtime double"
REMOTE_LISTING = "account string, position long, remote_id string, filename string, captured_at timestamp, size long, media_type string, is_live boolean"
ACTIONS = "action_id long, ts timestamp, photo_id long, status string"

STATUSES = ("optional", "selected", "rejected")


def blank_to_null(c):
    return F.when(c != "", c)


def check_invariants(photos: DataFrame) -> DataFrame:
    """Broken uniqueness rules: rule, key, n. Empty for a sound catalog."""
    paths = photos.groupBy("relative_path").count().filter("count > 1").select(F.lit("relative_path").alias("rule"), F.col("relative_path").alias("key"), F.col("count").alias("n"))
    remote = photos.filter("remote_id is not null").groupBy("account", "remote_id").count().filter("count > 1")
    remote = remote.select(F.lit("remote_id").alias("rule"), F.concat_ws(":", "account", "remote_id").alias("key"), F.col("count").alias("n"))
    return paths.union(remote)
