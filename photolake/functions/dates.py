"""Capture dates: tags, file names, modification times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1990, 2100
#: Name patterns tried in order, the first match of each only.
NAME_PATTERNS = (
    r"(?<!\d)(\d{4})(\d{2})(\d{2})_?(\d{2})(\d{2})(\d{2})(?!\d)",
    r"(?<!\d)(\d{4})-(\d{2})-(\d{2})[ _](\d{2})[.:-](\d{2})[.:-](\d{2})(?!\d)",
)


def _parse(text: Column, tz: str) -> Column:
    """YYYY:MM:DD HH:MM:SS as local time of tz, in UTC; null for anything else."""
    shape = r"^\s*(\d{4}):(\d{1,2}):(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})\s*$"
    part = [F.regexp_extract(text, shape, k).try_cast("int") for k in range(1, 7)]
    return F.when(part[5] <= 59, F.to_utc_timestamp(F.try_make_timestamp(*part), tz))


def exif_ts(original: Column, plain: Column, tz: str = "UTC") -> Column:
    """D2. The second tag only counts where the first is absent or empty."""
    return _parse(F.when(F.coalesce(original, F.lit("")) != "", original).otherwise(plain), tz)


def raw_ts(original: Column, created: Column, media_created: Column, tz: str = "UTC") -> Column:
    """D3. The first tag that isn't empty, even if it doesn't parse."""
    some = [F.when(F.trim(c) != "", c) for c in (original, created, media_created)]
    return _parse(F.coalesce(*some), tz)


def filename_ts(name: Column, tz: str = "UTC") -> Column:
    """D4. The first pattern whose first match is a real date between the years allowed."""
    found = []
    for p in NAME_PATTERNS:
        part = [F.regexp_extract(name, p, k).try_cast("int") for k in range(1, 7)]
        fine = part[0].between(FIRST_YEAR, LAST_YEAR) & (part[5] <= 59)
        found.append(F.when(fine, F.to_utc_timestamp(F.try_make_timestamp(*part), tz)))
    return F.coalesce(*found)


def mtime_ts(mtime: Column) -> Column:
    """D5."""
    return F.timestamp_micros((mtime * 1_000_000).cast("long"))


def capture_date(df: DataFrame, tz: str = "UTC") -> DataFrame:
    """D1. Adds captured_at and captured_at_source from tag columns, name and file_mtime."""
    tag = F.coalesce(raw_ts(F.col("raw_dto"), F.col("raw_cd"), F.col("raw_mcd"), tz), exif_ts(F.col("exif_datetime_original"), F.col("exif_datetime"), tz))
    named = filename_ts(F.element_at(F.split("relative_path", "/"), -1), tz)
    both = df.withColumn("_tag", tag).withColumn("_named", named)
    source = F.when(F.col("_tag").isNotNull(), "exif").when(F.col("_named").isNotNull(), "filename").otherwise("file_mtime")
    return both.withColumn("captured_at", F.coalesce("_tag", "_named", mtime_ts(F.col("file_mtime")))).withColumn("captured_at_source", source).drop("_tag", "_named")


def day_label(ts: Column) -> Column:
    """D6. `Sat 14 Jun 2025`."""
    return F.date_format(ts, "EEE d MMM yyyy")


def in_range(ts: Column, start: str | None = None, end: str | None = None) -> Column:
    """P14. Whole days, both inclusive, either end open."""
    ok = F.lit(True)
    if start:
        ok = ok & (ts >= F.lit(start).cast("date").cast("timestamp"))
    if end:
        ok = ok & (ts < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    return ok


def low_confidence() -> Column:
    """P15."""
    return F.col("captured_at_source") != "exif"
