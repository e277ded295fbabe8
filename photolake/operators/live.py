"""Still images and their motion clips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.functions.paths import parent_of, stem_of
from photolake.operators.joins import left_join_sparse

WINDOW_US = 1_000_000


def clear_dangling_companions(photos: DataFrame) -> DataFrame:
    """J8. A companion path without a present row is cleared."""
    present = photos.filter("not missing").select(F.col("relative_path").alias("_p")).distinct()
    joined = left_join_sparse(photos, present.select("_p", F.col("_p").alias("live_photo_video_path")), ["live_photo_video_path"], "id")
    kept = F.when(F.col("_p").isNotNull(), F.col("live_photo_video_path"))
    return joined.select(*(kept.alias(c) if c == "live_photo_video_path" else c for c in photos.columns))


def live_pairs(photos: DataFrame, content_id: str | None = None) -> DataFrame:
    """J7, J13. id of an image and path of its clip.

    Same directory and stem; of several clips the last by (captured_at, path)
    is taken first and must then be within one second. With a content
    identifier column, equal identifiers pair before names do.
    """
    local = photos.filter("not missing and source = 'local'").withColumn("_dir", parent_of("relative_path")).withColumn("_stem", F.lower(stem_of("relative_path"))).withColumn("_us", F.unix_micros("captured_at"))
    images = local.filter("media_type = 'image' and coalesce(live_photo_video_path, '') = ''")
    clips = local.filter(F.lower("relative_path").endswith(".mov"))
    out = None
    if content_id:
        by_id = clips.filter(f"{content_id} is not null").groupBy(content_id).agg(F.max_by("relative_path", F.struct("_us", "relative_path")).alias("clip"))
        out = images.join(by_id, content_id).select("id", "clip")
        images = images.join(out.select("id"), "id", "left_anti")
    last = clips.groupBy("_dir", "_stem").agg(F.max(F.struct("_us", "relative_path")).alias("c")).select("_dir", "_stem", F.col("c._us").alias("_cus"), F.col("c.relative_path").alias("clip"))
    named = images.join(last, ["_dir", "_stem"]).filter(F.abs(F.col("_us") - F.col("_cus")) <= WINDOW_US).select("id", "clip")
    return named if out is None else out.unionByName(named)


def pair_live_photos(photos: DataFrame, content_id: str | None = None) -> DataFrame:
    """The catalog after J8 and J7."""
    clean = clear_dangling_companions(photos)
    joined = clean.join(live_pairs(clean, content_id), "id", "left")
    return joined.select(*(F.coalesce("live_photo_video_path", "clip").alias(c) if c == "live_photo_video_path" else c for c in photos.columns))
