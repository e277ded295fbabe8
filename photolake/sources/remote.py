"""Remote account listings: pulls, download queues, landings."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.functions.dates import in_range
from photolake.functions.paths import account_slug, remote_sentinel
from photolake.operators.joins import left_join_sparse


def read_remote_listing(listing: DataFrame, since: str | None = None) -> DataFrame:
    """S8. A landed listing, optionally only what was captured after `since`; no size counts as 0, "movie" as video."""
    rows = listing.filter(F.col("captured_at") > F.lit(since).cast("timestamp")) if since else listing
    kind = F.when(F.col("media_type").isin("movie", "video"), "video").otherwise("image")
    return rows.withColumn("size", F.coalesce("size", F.lit(0)).cast("long")).withColumn("media_type", kind)


def new_items(photos: DataFrame, listing: DataFrame, downloaded: DataFrame) -> DataFrame:
    """R1. Listed items that are neither known nor downloaded, by id, whatever their date; of repeats the first listed."""
    key = ["account", "remote_id"]
    known = photos.filter("source = 'icloud' and remote_id is not null").select(*key).union(downloaded.select(*key))
    fresh = listing.join(known, key, "left_anti")
    first = fresh.groupBy(*key).agg(F.min_by(F.struct(*[c for c in listing.columns if c not in key]), "position").alias("x"))
    return first.select(*key, "x.*")


def remote_rows(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """R2. Catalog columns of new items."""
    joined = items.join(decisions.select("account", "remote_id", F.col("status").alias("_d")), ["account", "remote_id"], "left")
    return joined.select(
        remote_sentinel(F.col("account"), F.col("remote_id")).alias("relative_path"),
        F.when(F.col("_d") == "rejected", "rejected").otherwise("optional").alias("status"),
        account_slug("account").alias("provenance"), F.col("size").alias("file_size"), F.lit(0.0).alias("file_mtime"),
        "captured_at", F.lit("exif").alias("captured_at_source"), "media_type", F.lit(False).alias("missing"), F.lit("icloud").alias("source"),
        "account", "remote_id", F.coalesce("filename", F.lit("")).alias("remote_filename"), F.lit("").alias("original_path"),
    )


def pull(photos: DataFrame, listing: DataFrame, downloaded: DataFrame, decisions: DataFrame, top: int | None = None) -> DataFrame:
    """R1, R2. The catalog with the new items appended; known rows aren't refreshed. top: as for upsert_catalog()."""
    from photolake.operators.scan import upsert_catalog

    return upsert_catalog(photos, remote_rows(new_items(photos, listing, downloaded), decisions), "relative_path", [], top)


def download_queue(photos: DataFrame, downloaded: DataFrame, live_accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R3. (selected remote rows to fetch, in order of account and id; accounts without a session, once each)."""
    waiting = photos.filter("source = 'icloud' and status = 'selected' and remote_id is not null").join(downloaded.select("account", "remote_id"), ["account", "remote_id"], "left_anti")
    queue = waiting.join(live_accounts.select("account"), "account", "left_semi").select(*photos.columns).orderBy("account", "id")
    skipped = waiting.join(live_accounts.select("account"), "account", "left_anti").select("account").distinct()
    return queue, skipped


def land_downloads(photos: DataFrame, landed: DataFrame, downloaded: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """R4. (catalog, downloaded, decisions) after files have arrived.

    landed: account, remote_id, relative_path, file_size, file_mtime, clip_path,
    clip_size, clip_mtime (null without a motion clip). Capture date, account and
    remote id stay; a clip becomes a selected row of its own.
    """
    from photolake.operators.scan import upsert_catalog

    key = ["account", "remote_id"]
    got = landed.select(*key, *(F.col(c).alias(f"_{c}") for c in ("relative_path", "file_size", "file_mtime", "clip_path", "clip_size", "clip_mtime")))
    joined = left_join_sparse(photos, got, key, "id")
    hit = F.col("_relative_path").isNotNull() & (F.col("source") == "icloud")
    new = {
        "relative_path": F.col("_relative_path"), "file_size": F.col("_file_size"), "file_mtime": F.col("_file_mtime"), "provenance": account_slug("account"),
        "source": F.lit("local"), "missing": F.lit(False), "live_photo_video_path": F.coalesce("_clip_path", "live_photo_video_path"),
    }
    rows = joined.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in photos.columns))
    clips = joined.filter(hit & F.col("_clip_path").isNotNull()).select(
        F.col("_clip_path").alias("relative_path"), F.lit("selected").alias("status"), account_slug("account").alias("provenance"), F.col("_clip_size").alias("file_size"), F.col("_clip_mtime").alias("file_mtime"),
        "captured_at", "captured_at_source", F.lit("video").alias("media_type"), F.lit(False).alias("missing"), F.lit("local").alias("source"), F.lit("").alias("account"), F.lit("").alias("remote_filename"), F.lit("").alias("original_path"),
    )
    catalog = upsert_catalog(rows, clips, "relative_path", [])
    kept = downloaded.join(landed.select(*key), key, "left_anti").unionByName(landed.select(*key, "relative_path"))
    return catalog, kept, decisions.join(landed.select(*key), key, "left_anti")


def disconnect(photos: DataFrame, account: str) -> tuple[DataFrame, DataFrame]:
    """R5. (catalog without the account's remote rows, number removed). Rows already converted to local stay."""
    own = F.coalesce((F.col("source") == "icloud") & (F.col("account") == account), F.lit(False))
    return photos.filter(~own), photos.agg(F.count_if(own).alias("removed"))


def disconnect_plan(photos: DataFrame, previews: DataFrame, account: str, running: Collection[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """R5. (catalog, previews to delete, report) once an account is gone; its state and what it has landed stay.

    previews: name (icloud-{slug}-{remote id}....jpg) and any other columns.
    They go by the name's beginning, so those of an account whose slug goes on
    behind this one's and a hyphen go as well, and are made again. An account
    that is being pulled (running) is an error, an unknown one gives zeros.
    report: account, rows_removed, previews_removed.
    """
    if account in running:
        raise ValueError(f"{account} is being pulled; disconnect it when that has ended")
    kept, rows = disconnect(photos, account)
    own = F.col("name").startswith(F.concat(F.lit("icloud-"), account_slug(F.lit(account)), F.lit("-"))) & F.col("name").endswith(".jpg")
    gone = previews.filter(own)
    counted = rows.select(F.col("removed").alias("rows_removed"), F.lit(0).cast("long").alias("previews_removed")).unionAll(gone.agg(F.lit(0).cast("long"), F.count(F.lit(1))))
    report = counted.agg(F.sum("rows_removed").alias("rows_removed"), F.sum("previews_removed").alias("previews_removed"))
    return kept, gone, report.select(F.lit(account).alias("account"), "rows_removed", "previews_removed")


def advance_cursor(states: DataFrame, processed: DataFrame, complete: DataFrame) -> DataFrame:
    """A12. Cursors after a pull: the latest processed capture time, only for accounts whose listing was complete."""
    top = processed.groupBy("account").agg(F.max("captured_at").alias("_top")).join(complete.select("account"), "account", "left_semi")
    return states.join(top, "account", "left").select("account", F.greatest("cursor", "_top").alias("cursor"))


def preview_worklist(photos: DataFrame, previews: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """H5. id, account, remote_id, variant, prio of remote rows without a valid preview, those in range first within each account.

    previews: account, remote_id, is_jpeg. A video's preview that isn't JPEG is fetched again.
    """
    have = previews.select("account", "remote_id", F.coalesce("is_jpeg", F.lit(False)).alias("_jpeg")).groupBy("account", "remote_id").agg(F.max("_jpeg").alias("_jpeg"))
    rows = photos.filter("source = 'icloud' and remote_id is not null").join(have, ["account", "remote_id"], "left")
    todo = rows.filter(F.col("_jpeg").isNull() | ((F.col("media_type") == "video") & ~F.col("_jpeg")))
    out = todo.select("id", "account", "remote_id", F.when(F.col("media_type") == "video", "thumb_image").otherwise("thumb").alias("variant"), F.when(in_range(F.col("captured_at"), start, end), 0).otherwise(1).alias("prio"), "captured_at")
    return out.repartition("account", "prio").sortWithinPartitions("account", "prio", "captured_at", "id")


def rebuild_catalog(empty: DataFrame, listing: DataFrame, remote_listing: DataFrame, downloaded: DataFrame, decisions: DataFrame) -> DataFrame:
    """R7. A catalog from nothing but listings and sidecar state."""
    from photolake.operators.scan import apply_listing

    return pull(apply_listing(empty, listing), remote_listing, downloaded, decisions)
