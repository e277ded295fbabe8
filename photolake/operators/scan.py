"""Scans: a listing against the catalog, moved files, several roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photolake.functions.paths import media_type_of, provenance_of, sentinel, status_of
from photolake.operators.ranks import rank_within
from photolake.session import stash

TOLERANCE = 1e-6
#: Columns of a catalog row that a listed file sets anew, and what others have in a new row, where they aren't null.
LISTED_COLS = ["status", "provenance", "file_size", "file_mtime", "media_type", "captured_at", "captured_at_source", "missing"]
NEW_ROW = {"source": "local", "account": "", "remote_filename": "", "original_path": ""}


def number_new(fresh: DataFrame, key: str, top: int) -> DataFrame:
    """Adds _id, counted on from top in the order of the key; counted per range partition, so no task sorts all rows."""
    placed = stash(fresh.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "fresh")
    sizes = placed.groupBy("_part").count().select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return placed.join(F.broadcast(sizes), "_part").withColumn("_id", F.lit(top) + F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(key)))


def upsert_catalog(photos: DataFrame, changes: DataFrame, key: str, update_cols: list[str], top: int | None = None) -> DataFrame:
    """S7. Changed rows get the listed columns, new keys are added with ids after the largest (top, where photos are a part of the catalog), the rest stays.

    New ids follow the order of the key.
    """
    fresh = changes.join(photos.select(key), key, "left_anti")
    top = photos.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if top is None else top
    numbered = number_new(fresh, key, top)
    new = numbered.select(*(F.col("_id").alias("id") if c == "id" else (F.col(c) if c in changes.columns else F.lit(None).cast(photos.schema[c].dataType).alias(c)) for c in photos.columns))
    if not update_cols:
        return photos.unionByName(new)
    upd = changes.select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_u_{c}") for c in update_cols))
    kept = photos.join(upd, key, "left").select(*(F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in update_cols else F.col(c) for c in photos.columns))
    return kept.unionByName(new)


def diff_listing(photos: DataFrame, listing: DataFrame) -> DataFrame:
    """J1. relative_path, kind (unchanged, changed, new, vanished) of the library's own files, with both sides' size and mtime.

    Rows of registered sources and remote rows are out of scope.
    """
    own = photos.filter("source = 'local' and source_ref is null").select("relative_path", "id", "missing", F.col("file_size").alias("old_size"), F.col("file_mtime").alias("old_mtime"))
    joined = own.join(listing.select("relative_path", "file_size", "file_mtime"), "relative_path", "full_outer")
    return joined.withColumn("kind", _kind())


def _kind():
    """Of a library row (id, missing, old_size, old_mtime) beside a listed file (file_size, file_mtime)."""
    same = ~F.col("missing") & (F.col("file_size") == F.col("old_size")) & (F.abs(F.col("file_mtime") - F.col("old_mtime")) < TOLERANCE)
    return F.when(F.col("id").isNull(), "new").when(F.col("file_size").isNull() & F.col("file_mtime").isNull(), "vanished").when(same, "unchanged").otherwise("changed")


def listed_rows(listing: DataFrame, *more: str) -> DataFrame:
    """What the catalog takes from listed files: the path, LISTED_COLS and `more`."""
    path = F.col("relative_path")
    own = {"status": status_of(path), "provenance": provenance_of(path), "media_type": media_type_of(path), "missing": F.lit(False)}
    return listing.select("relative_path", *(own[c].alias(c) if c in own else F.col(c) for c in LISTED_COLS), *more)


def listed_changes(photos: DataFrame, since: DataFrame | None, listing: DataFrame, top: int) -> DataFrame:
    """J2 without the rows that stay: relative_path, LISTED_COLS, id (of new rows, else null) of new and changed files.

    photos: the catalog, or the part of it with the listed paths; since: what
    has changed in it, as with_changes() takes it. Each is dealt out once, by
    the few columns that tell a change.
    """
    own = (F.col("source") == "local") & F.col("source_ref").isNull()
    known = photos.select("relative_path", F.col("id").alias("_there"), own.alias("_own"), "missing", F.col("file_size").alias("old_size"), F.col("file_mtime").alias("old_mtime"))
    joined = listing.join(known, "relative_path", "left")
    if since is not None:
        newer = since.select("relative_path", F.lit(True).alias("_since"), F.col("id").alias("_new_id"), F.col("file_size").alias("_size"), F.col("file_mtime").alias("_mtime"))
        joined = joined.join(newer, "relative_path", "left")
        late = F.col("_since").isNotNull()
        joined = joined.withColumns({
            "_there": F.coalesce("_there", "_new_id"), "_own": F.coalesce("_own", late), "missing": F.when(late, False).otherwise(F.col("missing")),
            "old_size": F.when(late, F.col("_size")).otherwise(F.col("old_size")), "old_mtime": F.when(late, F.col("_mtime")).otherwise(F.col("old_mtime")),
        })
    # A row of another source or account with a listed path counts as new in diff_listing(), and takes what is listed.
    kind = _kind()
    joined = joined.withColumn("id", F.when(F.col("_own"), F.col("_there"))).filter(F.col("relative_path").isNotNull() & _kind().isin("new", "changed"))
    found = stash(listed_rows(joined.drop("missing"), "_there"), "found")
    new = number_new(found.filter("_there is null"), "relative_path", top)
    return found.filter("_there is not null").select("relative_path", *LISTED_COLS, F.lit(None).cast("long").alias("id")).unionByName(new.select("relative_path", *LISTED_COLS, F.col("_id").alias("id")))


def with_changes(photos: DataFrame, since: DataFrame | None) -> DataFrame:
    """The catalog with changes as listed_changes() gives them, one row a path. Applying them again changes nothing."""
    if since is None:
        return photos
    later = since.select("relative_path", F.lit(True).alias("_since"), F.col("id").alias("_new_id"), *(F.col(c).alias(f"_new_{c}") for c in LISTED_COLS))
    joined = photos.withColumn("_there", F.lit(True)).join(later, "relative_path", "full_outer")
    there, late = F.col("_there").isNotNull(), F.col("_since").isNotNull()

    def column(c: str):
        if c == "id":
            return F.when(there, F.col(c)).otherwise(F.col("_new_id")).alias(c)
        if c in LISTED_COLS:
            return F.when(late, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        return F.when(there, F.col(c)).otherwise(F.lit(NEW_ROW[c])).alias(c) if c in NEW_ROW else F.col(c)

    return joined.select(*map(column, photos.columns))


def apply_listing(photos: DataFrame, listing: DataFrame, keep_stale_hashes: bool = True, top: int | None = None) -> DataFrame:
    """J2. The catalog with new and changed rows read anew. listing also has captured_at, captured_at_source.

    Other columns of a changed row stay; with keep_stale_hashes even its old hashes.
    """
    diff = diff_listing(photos, listing).filter("kind in ('new', 'changed')").select("relative_path", "kind")
    rows = listed_rows(listing.join(diff, "relative_path")).select("*", F.lit(0).cast("long").alias("id"), *(F.lit(v).alias(c) for c, v in NEW_ROW.items()))
    cols = list(LISTED_COLS)
    if not keep_stale_hashes:
        rows = rows.withColumn("sha256", F.lit(None).cast("string")).withColumn("phash", F.lit(None).cast("string"))
        cols += ["sha256", "phash"]
    return upsert_catalog(photos, rows, "relative_path", cols, top)


def mark_missing(photos: DataFrame, gone: DataFrame) -> DataFrame:
    """J3. Rows whose id is in `gone` become missing."""
    hit = gone.select("id", F.lit(True).alias("_gone")).distinct()
    return photos.join(hit, "id", "left").select(*((F.col("missing") | F.coalesce("_gone", F.lit(False))).alias("missing") if c == "missing" else c for c in photos.columns))


def reconcile_moves(vanished: DataFrame, new: DataFrame) -> DataFrame:
    """J4. id and new_path of vanished rows that turn up elsewhere with exactly equal size and time.

    vanished: root_id, id, captured_at, file_size, file_mtime, sha256.
    new: root_id, relative_path, file_size, file_mtime, sha256. In the order of
    (captured_at, id, no date last), a hashed row takes the first free path of its
    hash, an unhashed one the path that is left if it is the only one; others are
    ambiguous.

    Hashed rows meet paths by their ranks. An unhashed row can only act once all
    paths of its group but one are taken: the first one after that takes the last
    path, and a hashed row that would have come to it later goes without.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    group = F.concat_ws("|", text("root_id"), text("file_size"), text("file_mtime")).alias("_k")
    hashed = F.coalesce("sha256", F.lit("")) != ""
    gone = vanished.select(group, "id", "sha256", F.struct(F.col("captured_at").isNull().alias("none"), F.col("captured_at").alias("at"), "id").alias("_o"))
    paths = new.select(group, "relative_path", "sha256").distinct()
    gone = stash(gone.join(paths.select("_k").distinct(), "_k", "left_semi"), "gone")
    paths = stash(paths.join(gone.select("_k").distinct(), "_k", "left_semi"), "paths")
    v = rank_within(gone.filter(hashed), ["_k", "sha256"], ["_o"], "_n")
    w = rank_within(paths.filter(hashed), ["_k", "sha256"], ["relative_path"], "_n")
    met = stash(v.join(w, ["_k", "sha256", "_n"]).select("_k", "id", "_o", F.col("relative_path").alias("new_path")), "met")

    blank = gone.filter(~hashed).select("_k", "_o")
    sizes = paths.join(blank.select("_k").distinct(), "_k", "left_semi").groupBy("_k").agg(F.count(F.lit(1)).alias("_paths"))
    taken = rank_within(met.join(sizes, "_k"), ["_k"], ["_o"], "_s")
    last_but_one = taken.filter("_s = _paths - 2").select("_k", F.col("_o").alias("_since"))
    open_ = sizes.join(last_but_one, "_k", "left").filter("_paths = 1 or _since is not null")
    heir = blank.join(open_, "_k").filter("_since is null or _o > _since").groupBy("_k").agg(F.min("_o").alias("_heir"))
    beaten = taken.filter("_s = _paths - 1").join(heir, "_k").filter("_heir > _o").select("_k")
    heir = heir.join(beaten, "_k", "left_anti")
    before = taken.filter("_s < _paths - 1").select("_k", F.col("new_path").alias("relative_path"))
    left = paths.join(heir.select("_k"), "_k", "left_semi").join(before, ["_k", "relative_path"], "left_anti")
    inherited = stash(left.join(heir, "_k").select(F.col("_heir.id").alias("id"), F.col("relative_path").alias("new_path"), "_k"), "inherited")
    lost = inherited.select("_k", "new_path")
    return met.join(lost, ["_k", "new_path"], "left_anti").select("id", "new_path").unionByName(inherited.select("id", "new_path"))


def relink(photos: DataFrame, moves: DataFrame) -> DataFrame:
    """J4, J5. Moved rows get their new path and are present; the placeholder rows of those paths go.

    Library rows take status and provenance from the path, source rows keep theirs.
    """
    placeholder = moves.select(F.col("new_path").alias("relative_path"))
    rest = photos.join(placeholder, "relative_path", "left_anti").join(moves, "id", "left")
    moved, own = F.col("new_path").isNotNull(), F.col("new_path").isNotNull() & F.col("source_ref").isNull()
    new = {
        "relative_path": F.coalesce("new_path", "relative_path"),
        "missing": F.when(moved, False).otherwise(F.col("missing")),
        "status": F.when(own, status_of("new_path")).otherwise(F.col("status")),
        "provenance": F.when(own, provenance_of("new_path")).otherwise(F.col("provenance")),
    }
    return rest.select(*(new[c].alias(c) if c in new else c for c in photos.columns))


def scan_library(photos: DataFrame, listing: DataFrame, top: int | None = None) -> DataFrame:
    """J1 to J5. The catalog after a scan that listed all files of the library.

    listing: relative_path, file_size, file_mtime, captured_at,
    captured_at_source, sha256 (of new files, where moved ones are to be told by
    hash). Rows that had vanished before can turn up elsewhere too.
    """
    diff = stash(diff_listing(photos, listing).select("relative_path", "id", "kind"), "diff")
    root = F.lit(0).alias("root_id")
    vanished = photos.join(diff.filter("kind = 'vanished'").select("id"), "id", "left_semi")
    new = listing.join(diff.filter("kind = 'new'").select("relative_path"), "relative_path", "left_semi")
    moves = stash(reconcile_moves(vanished.select("*", root), new.select("*", root)), "moves")
    gone = vanished.select("id").join(moves.select("id"), "id", "left_anti")
    return relink(mark_missing(apply_listing(photos, listing, top=top), gone), moves)


def scan_sources(photos: DataFrame, listing: DataFrame, sources: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J6. (diff, errors) over all registered local sources, each on its own.

    listing: root_id (the source's id), relative_path within it, sizes, times.
    Status comes from the sidecar's decisions; a row is unchanged only with
    equal status. A source without any listed file is unreachable: an error
    row, and its photos stay as they are.
    """
    local = sources.filter("kind = 'local'").select(F.col("id").alias("root_id"), "name")
    there = listing.select("root_id").distinct()
    errors = local.join(there, "root_id", "left_anti").select("root_id", "name", F.lit("unreachable").alias("error"))
    named = decisions.select(F.col("source_id").alias("root_id"), "relative_path", F.col("status").alias("decided"))
    listed = listing.join(local, "root_id").join(named, ["root_id", "relative_path"], "left")
    listed = listed.select("root_id", sentinel(F.col("root_id"), F.col("relative_path")).alias("relative_path"), "file_size", "file_mtime", F.col("name").alias("provenance"), F.coalesce("decided", F.lit("optional")).alias("status"))
    own = photos.filter("source_ref is not null").join(there.withColumnRenamed("root_id", "source_ref"), "source_ref", "left_semi")
    own = own.select(F.col("source_ref").alias("root_id"), "relative_path", "id", "missing", F.col("file_size").alias("old_size"), F.col("file_mtime").alias("old_mtime"), F.col("status").alias("old_status"))
    joined = own.join(listed, ["root_id", "relative_path"], "full_outer")
    same = ~F.col("missing") & (F.col("file_size") == F.col("old_size")) & (F.abs(F.col("file_mtime") - F.col("old_mtime")) < TOLERANCE) & (F.col("status") == F.col("old_status"))
    kind = F.when(F.col("id").isNull(), "new").when(F.col("status").isNull(), "vanished").when(same, "unchanged").otherwise("changed")
    return joined.withColumn("kind", kind), errors
