"""Timelines: filtered, ordered, paged, with neighbours.

Nothing here puts all rows into one task: global positions come from a range
partitioning, ranks inside its partitions, and offsets from their sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photolake.functions.dates import day_label, in_range, low_confidence
from photolake.operators.dedup import duplicate_counts, representatives
from photolake.operators.ranks import rank_within
from photolake.session import stash

PAGE = 200
#: Pages from the start that are read without ranking all rows.
NEAR = 10


def companion_paths(photos: DataFrame) -> DataFrame:
    """T3. Paths of motion clips that a present row holds."""
    held = photos.filter("not missing and live_photo_video_path is not null and live_photo_video_path <> ''")
    return held.select(F.col("live_photo_video_path").alias("relative_path")).distinct()


def timeline(photos: DataFrame, status: str | None = None, provenance: str | None = None, date_from: str | None = None, date_to: str | None = None, low_confidence_only: bool = False, show_missing: bool = False, media_type: str | None = None, unresolved_in: DataFrame | None = None) -> DataFrame:
    """T1, T2, T13. Rows of the timeline, not ordered.

    Copies and companions are hidden over the whole catalog before any filter,
    so a filter never brings a hidden copy back. The missing-only view hides nothing.
    """
    if show_missing:
        rows = photos.filter("missing")
    else:
        best = representatives(photos).filter("n > 1").select("sha256", F.col("id").alias("_keep"))
        rows = photos.filter("not missing").join(best, "sha256", "left").filter("_keep is null or id = _keep")
        rows = rows.join(companion_paths(photos), "relative_path", "left_anti")
    if status:
        rows = rows.filter(F.col("status") == status)
    if provenance is not None:
        rows = rows.filter(F.col("provenance") == provenance)
    rows = rows.filter(in_range(F.col("captured_at"), date_from, date_to))
    if low_confidence_only:
        rows = rows.filter(low_confidence())
    if media_type:
        rows = rows.filter(F.col("media_type") == media_type)
    if unresolved_in is not None:
        open_ids = unresolved_in.filter("not resolved").select(F.explode(F.array("photo_a", "photo_b")).alias("id"))
        rows = rows.join(open_ids, "id", "left_semi")
    return rows.select(*photos.columns)


def ordered(rows: DataFrame, order: str = "asc") -> DataFrame:
    return rows.orderBy("captured_at", "id") if order == "asc" else rows.orderBy(F.desc("captured_at"), F.desc("id"))


def with_badges(rows: DataFrame, photos: DataFrame) -> DataFrame:
    """T9. dupe_count (0 for none), is_live, download_pending."""
    shown = rows.select("sha256").distinct()
    counts = duplicate_counts(photos.join(shown, "sha256", "left_semi")).withColumnRenamed("n", "dupe_count")
    joined = rows.join(counts, "sha256", "left")
    return joined.select(
        *rows.columns,
        F.coalesce("dupe_count", F.lit(0)).cast("long").alias("dupe_count"),
        (F.coalesce("live_photo_video_path", F.lit("")) != "").alias("is_live"),
        ((F.col("source") == "icloud") & (F.col("status") == "selected")).alias("download_pending"),
    )


def ranked(rows: DataFrame, columns: list[str], descending: bool = False) -> DataFrame:
    """Adds pos, from 0, in the order of (captured_at, id): range partitions, ranks within, offsets from the partitions' sizes."""
    keys = [F.desc(c) if descending else F.asc(c) for c in ("captured_at", "id")]
    placed = stash(rows.select(*columns).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranked")
    within = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    sizes = placed.groupBy("_part").count()  # one row for each partition
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return within.join(F.broadcast(before), "_part").withColumn("pos", F.col("_before") + F.col("_n") - 1).drop("_part", "_n", "_before")


def page(rows: DataFrame, number: object = 1, size: int = PAGE, descending: bool = False) -> DataFrame:
    """T4. The page's rows with their position; a non-number is page 1, a number out of range the last page."""
    try:
        wanted = int(number)
    except (TypeError, ValueError):
        wanted = 1
    keys = [F.desc(c) if descending else F.asc(c) for c in ("captured_at", "id")]
    if 1 <= wanted <= NEAR:  # the top rows are cheaper than a rank of all
        top = stash(rows.orderBy(*keys).limit(wanted * size), "top")
        if (total := top.count()) <= (wanted - 1) * size:  # these are all rows there are
            wanted = max(1, -(-total // size))
        return top.orderBy(*keys).offset((wanted - 1) * size).limit(size)
    found = ranked(rows, ["captured_at", "id"], descending)  # keys alone; the page's rows are joined back
    last = max(1, -(-found.count() // size))
    wanted = wanted if 1 <= wanted <= last else last
    own = found.filter(F.col("pos").between((wanted - 1) * size, wanted * size - 1)).select("id")
    return rows.join(own, "id", "left_semi").select(*rows.columns).orderBy(*keys)


def page_after(rows: DataFrame, captured_at, photo_id: int, size: int = PAGE) -> DataFrame:
    """T4 by key: the rows that follow one known row, without counting those before it."""
    at = F.lit(captured_at).cast("timestamp")
    later = (F.col("captured_at") > at) | ((F.col("captured_at") == at) & (F.col("id") > photo_id))
    return rows.filter(later).orderBy("captured_at", "id").limit(size)


def by_day(rows: DataFrame) -> DataFrame:
    """T5. day, label and number of rows."""
    days = rows.groupBy(F.to_date("captured_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.select("day", day_label(F.col("day").cast("timestamp")).alias("label"), "n")


def by_day_items(page_rows: DataFrame) -> DataFrame:
    """T5 of one page: day, label, ids in order."""
    items = F.sort_array(F.collect_list(F.struct("captured_at", "id")))
    days = page_rows.groupBy(F.to_date("captured_at").alias("day")).agg(items.alias("_i"))
    return days.select("day", day_label(F.col("day").cast("timestamp")).alias("label"), F.col("_i.id").alias("ids"))


def neighbours(rows: DataFrame) -> DataFrame:
    """T6. id, prev_id, next_id, index (from 0), total."""
    pos = stash(ranked(rows, ["id", "captured_at"]).select("id", "pos"), "positions")
    total = pos.count()
    before = pos.select(F.col("id").alias("prev_id"), (F.col("pos") + 1).alias("pos"))
    after = pos.select(F.col("id").alias("next_id"), (F.col("pos") - 1).alias("pos"))
    out = pos.join(before, "pos", "left").join(after, "pos", "left")
    return out.select("id", "prev_id", "next_id", F.col("pos").alias("index"), F.lit(total).cast("long").alias("total"))


def filmstrip(rows: DataFrame, radius: int = 10) -> DataFrame:
    """T7. id and the ids around it in order, clipped at the ends."""
    pos = stash(ranked(rows, ["id", "captured_at"]).select("id", "pos"), "positions")
    around = pos.select(F.col("id").alias("other"), F.col("pos").alias("at"), F.explode(F.sequence(F.col("pos") - radius, F.col("pos") + radius)).alias("pos"))
    strip = around.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("at", "other"))).alias("_s"))
    return pos.join(strip, "pos").select("id", F.col("_s.other").alias("ids"))


def recent_activity(photos: DataFrame, limit: int = 10) -> DataFrame:
    """T10. Rows whose status changed last; ties go to the higher id."""
    return photos.filter("status_changed_at is not null").orderBy(F.desc("status_changed_at"), F.desc("id")).limit(limit)


def distinct_provenances(photos: DataFrame) -> DataFrame:
    """A13."""
    return photos.filter("provenance <> ''").select("provenance").distinct().orderBy("provenance")


def date_rank(photos: DataFrame, probes: DataFrame) -> DataFrame:
    """T12. For each probe (account, at): rank (rows of the account captured later), offset, limit of the window to scan (wanted items around it).

    Probes and rows are sorted together, latest first and probes before rows of
    their time: a probe's rank is its place less the probes before it.
    """
    when = (-F.unix_micros("at")).alias("_t")
    asked = probes.select("account", "at", "wanted").distinct().select("*", when, F.lit(0).alias("_row"))
    rows = photos.filter("source = 'icloud' and captured_at is not null").select("account", F.col("captured_at").alias("at"), F.lit(None).cast(probes.schema["wanted"].dataType).alias("wanted"))
    both = asked.unionByName(rows.select("*", when, F.lit(1).alias("_row")))
    places = rank_within(both, ["account"], ["_t", "_row", "wanted"], "_place").filter("_row = 0")
    rank = rank_within(places, ["account"], ["_t", "wanted"], "_before").withColumn("rank", F.col("_place") - F.col("_before"))
    return rank.select("account", "at", "rank", F.greatest(F.lit(0), F.col("rank") - 25).alias("offset"), F.least(F.lit(400), 4 * F.col("wanted") + 120).cast("long").alias("limit"))
