"""Path and name expressions. Paths are POSIX, relative to a root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The media extensions that are listed.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".heic", ".heif", ".tif", ".tiff", ".dng", ".cr2", ".cr3", ".nef", ".arw", ".raf", ".orf", ".rw2")
VIDEO_EXTENSIONS = (".mov", ".mp4", ".m4v", ".avi")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def name_of(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def parent_of(path: Column | str) -> Column:
    """Directory of a path; "." at the root."""
    p = F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)
    return F.when(_col(path).contains("/"), p).otherwise(F.lit("."))


def suffix_of(path: Column | str) -> Column:
    """Last extension with its dot, as written; "" for none and for names that only begin with a dot."""
    return F.regexp_extract(name_of(path), r"[^.](\.[^.]+)$", 1)


def stem_of(path: Column | str) -> Column:
    name = name_of(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix_of(path)))


def status_of(path: Column | str) -> Column:
    """P1. The first segment names the status, even if it is a file of that name."""
    first = F.element_at(F.split(_col(path), "/"), 1)
    return F.when(first.isin("selected", "rejected"), first).otherwise(F.lit("optional"))


def provenance_of(path: Column | str) -> Column:
    """P2. First segment after a status segment, if a directory; else ""."""
    parts = F.split(_col(path), "/")
    skip = F.when(F.element_at(parts, 1).isin("selected", "rejected"), 1).otherwise(0)
    return F.when(F.size(parts) - skip > 1, F.try_element_at(parts, skip + 1)).otherwise(F.lit(""))


def media_type_of(path: Column | str) -> Column:
    """P3."""
    return F.when(F.lower(suffix_of(path)).isin(*VIDEO_EXTENSIONS), F.lit("video")).otherwise(F.lit("image"))


def parent_stem(path: Column | str) -> Column:
    """P4. (directory, lower-cased stem) as one struct; the directory keeps its case."""
    return F.struct(parent_of(path).alias("parent"), F.lower(stem_of(path)).alias("stem"))


def sentinel(source_id: Column, rel: Column) -> Column:
    """P5. Catalog path of a file under a registered source."""
    return F.concat(F.lit("@src/"), source_id.cast("string"), F.lit("/"), rel)


def rel_from_sentinel(path: Column | str) -> Column:
    """P5. Source-relative path; "" if malformed."""
    return F.regexp_extract(_col(path), r"^@src/[^/]*/(.*)$", 1)


def remote_sentinel(account: Column, remote_id: Column) -> Column:
    return F.concat(F.lit("@icloud/"), account, F.lit("/"), remote_id)


def is_media(path: Column | str) -> Column:
    """S2. A media file none of whose path segments begins with a dot."""
    known = F.lower(F.regexp_extract(name_of(path), r"(\.[^./]+)$", 1)).isin(*IMAGE_EXTENSIONS, *VIDEO_EXTENSIONS)
    return ~_col(path).rlike(r"(^|/)\.") & known


def filter_media(df: DataFrame, path_col: str = "relative_path") -> DataFrame:
    """S2 over an inventory table."""
    return df.filter(is_media(path_col))


def account_slug(account: Column | str) -> Column:
    """P7. For display and file names; not injective, so never a join key."""
    slug = F.regexp_replace(F.lower(F.trim(_col(account))), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.when(slug == "", F.lit("account")).otherwise(F.coalesce(slug, F.lit("account")))


def origin_label(account: Column | str = "account", provenance: Column | str = "provenance") -> Column:
    """P8."""
    a, p = _col(account), _col(provenance)
    local = F.concat(F.lit("Local · "), F.when(p != "", p).otherwise(F.lit("root")))
    return F.when(a != "", F.concat(F.lit("iCloud · "), a)).otherwise(local)


def human_size(size: Column | str) -> Column:
    """P9. Bytes as an integer, above that two decimals (halves to even) in steps of 1024 up to TB."""
    n = _col(size).cast("double")
    out = F.concat(_col(size).cast("long").cast("string"), F.lit(" bytes"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= float(1024**k), F.format_string(f"%.2f {unit}", F.bround(n / float(1024**k), 2))).otherwise(out)
    return out


def export_name(name: Column, captured_at: Column, dated: bool) -> Column:
    """P10. The date goes first if asked for and known."""
    return F.when(F.lit(dated) & captured_at.isNotNull(), F.concat(F.date_format(captured_at, "yyyy-MM-dd"), F.lit("_"), name)).otherwise(name)


def remote_target_name(filename: Column, remote_id: Column, has_alpha: Column) -> Column:
    """P11. Name that a remote item lands under; HEIC becomes JPEG, or PNG with transparency."""
    base = F.coalesce(F.when(F.coalesce(filename, F.lit("")) != "", name_of(filename)), F.concat(remote_id, F.lit(".jpg")))
    heic = F.lower(suffix_of(base)).isin(".heic", ".heif")
    return F.when(heic, F.concat(stem_of(base), F.when(has_alpha, F.lit(".png")).otherwise(F.lit(".jpg")))).otherwise(base)


def resolve_paths(photos: DataFrame, sources: DataFrame, library: str) -> DataFrame:
    """P6. Adds abs_path, and path_error for rows that have no file."""
    roots = sources.select(F.col("id").alias("source_ref"), F.col("path").alias("_root"))
    joined = photos.join(roots, "source_ref", "left")
    rel, under = F.col("relative_path"), F.col("relative_path").startswith("@src/")
    error = F.when(F.col("source") == "icloud", F.lit("remote")).when(under & F.col("_root").isNull(), F.lit("no source"))
    path = F.when(F.col("_root").isNotNull(), F.concat_ws("/", "_root", rel_from_sentinel(rel))).otherwise(F.concat_ws("/", F.lit(library), rel))
    return joined.withColumn("path_error", error).withColumn("abs_path", F.when(error.isNull(), path)).select(*photos.columns, "abs_path", "path_error")
