"""Move and export plans. Nothing is renamed or copied here; the plans say what to do."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photolake.functions.paths import export_name, media_type_of, name_of, parent_of, provenance_of, status_of, stem_of, suffix_of
from photolake.operators.joins import left_join_sparse
from photolake.operators.ranks import rank_within
from photolake.session import stash, use_package


def dest_path(path: Column, original_path: Column, provenance: Column, new_status: Column) -> Column:
    """U1. Where a file goes when it gets a status."""
    first, name = F.element_at(F.split(path, "/"), 1), name_of(path)
    placed = first.isin("selected", "rejected") & path.contains("/")
    rest = F.when(first.isin("selected", "rejected"), F.regexp_extract(path, "^[^/]*/(.*)$", 1)).otherwise(path)
    deep = F.when(rest.contains("/"), rest).when(F.coalesce(provenance, F.lit("")) != "", F.concat_ws("/", provenance, name)).otherwise(name)
    origin = F.when(F.coalesce(original_path, F.lit("")) != "", original_path).when(placed, deep).otherwise(path)
    rejected = F.concat(F.lit("rejected/"), F.when(status_of(path) == "selected", origin).otherwise(rest))
    return F.when(new_status == "selected", F.concat(F.lit("selected/"), name)).when(new_status == "rejected", rejected).when(new_status == "optional", origin)


def family(path: Column) -> list[Column]:
    """Paths that can clash by numbering: directory, stem without any trailing " (n)", extension."""
    return [parent_of(path).alias("_dir"), F.regexp_replace(stem_of(path), r"( \(\d+\))+$", "").alias("_stem"), suffix_of(path).alias("_ext")]


#: A name as what numbering leaves alone and the extension behind the number.
_PARTS = r"(?s)^(.*?[^./])(\.[^./]+)?$"


def _numbered(path: Column, n: Column) -> Column:
    base = F.when(F.regexp_extract(path, _PARTS, 1) == "", path).otherwise(F.regexp_extract(path, _PARTS, 1))
    return F.when(n == 0, path).otherwise(F.concat(base, F.lit(" ("), n.cast("string"), F.lit(")"), F.regexp_extract(path, _PARTS, 2)))


def _number_in(path: Column, like: Column) -> Column:
    """The number that `path` has as a numbered form of `like` (0 for itself), else null."""
    base = F.when(F.regexp_extract(like, _PARTS, 1) == "", like).otherwise(F.regexp_extract(like, _PARTS, 1))
    ext = F.regexp_extract(like, _PARTS, 2)
    middle = F.substring(path, F.length(base) + 1, F.length(path) - F.length(base) - F.length(ext))
    n = F.regexp_extract(middle, r"^ \(([1-9][0-9]{0,17})\)$", 1)
    return F.when(path == like, F.lit(0).cast("long")).when(path.startswith(base) & path.endswith(ext) & (n != ""), n.cast("long"))


#: A numbered name: what it numbers, the number, the extension.
_NUMBERED_NAME = r"(?s)^(.*[^./]) \(([1-9][0-9]{0,17})\)(\.[^./]+)?$"


def _parent(path: Column) -> Column:
    """The name that `path` is a numbered form of, else null."""
    whole = F.concat(F.regexp_extract(path, _NUMBERED_NAME, 1), F.regexp_extract(path, _NUMBERED_NAME, 3))
    return F.when(F.coalesce(_number_in(path, whole), F.lit(0)) > 0, whole)


def _depth(path: Column) -> Column:
    """Numbers at the end of a name's stem."""
    return F.length(F.regexp_replace(F.regexp_extract(stem_of(path), r"((?: \([0-9]+\))*)$", 1), r"[^(]", ""))


def _passed_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over the taken or asked numbers of names, sorted: which are passed over by the claimants that go on to numbers.

    A number goes to a claimant instead if that comes to it before its own
    first one: less, its place less one and the claimants that are earlier than
    it, tells when.
    """
    now, passed = None, 0
    for b in batches:
        out = []
        for base, less in zip(b.column("base").to_pylist(), b.column("less").to_pylist(), strict=True):
            if base != now:
                now, passed = base, 0
            out.append(passed <= less)
            passed += passed <= less
        yield pa.RecordBatch.from_arrays([b.column("base"), b.column("path"), b.column("n"), pa.array(out, pa.bool_())], ["base", "path", "n", "passed"])


def _assign_mixed(claims: DataFrame, there: DataFrame, columns: list[str]) -> DataFrame:
    """final_path in families where different names clash, level by level of numbers in a name.

    A name's first claimant gets it, unless it is there or a claimant of what it
    numbers has come to it before. The others of a name go on to its numbers, of
    which those are passed over that are there or whose own first claimant is
    earlier. Claimants of one name then get the numbers left by rank. Rows are
    sorted and counted over tasks; a task that goes through a name's numbers
    remembers one count.
    """
    claims = claims.withColumn("_o", F.struct("ord", "key"))
    names = stash(claims.groupBy("path").agg(F.min("_o").alias("_first")).withColumn("_there", F.lit(False)), "names")
    known = there.select("path", F.lit(None).cast(names.schema["_first"].dataType).alias("_first"), F.lit(True).alias("_there"))
    nodes = names.unionByName(known).groupBy("path").agg(F.max("_first").alias("_first"), F.max("_there").alias("_there"))
    nodes = stash(nodes.withColumn("base", _parent(F.col("path"))).withColumn("n", _number_in(F.col("path"), F.col("base"))).withColumn("_level", _depth(F.col("path"))), "nodes")
    stolen = nodes.select("path").filter("false")
    done = None
    for level in [r[0] for r in nodes.filter("_first is not null").select("_level").distinct().orderBy("_level").collect()]:
        own = nodes.filter((F.col("_level") == level) & F.col("_first").isNotNull()).join(stolen.withColumn("_stolen", F.lit(True)), "path", "left")
        own = stash(own.select("path", F.when(~F.col("_there") & F.col("_stolen").isNull(), F.col("_first")).alias("_winner")), "own")
        here = claims.join(own, "path").withColumn("_wins", F.coalesce(F.col("_o") == F.col("_winner"), F.lit(False)))
        more = stash(here.filter("not _wins").select(F.col("path").alias("base"), "_o", *columns), "more")
        asked = nodes.filter("base is not null").join(more.select("base").distinct(), "base", "left_semi").select("base", "path", "n", F.when(~F.col("_there"), F.col("_first")).alias("_first"))
        # How many of a name's claimants that go on are earlier than each number's own first one.
        times = more.select("base", "_o", F.lit(0).alias("_kind")).unionByName(asked.filter("_first is not null").select("base", F.col("_first").alias("_o"), F.lit(1).alias("_kind"), "path"), allowMissingColumns=True)
        place = rank_within(times, ["base"], ["_o", "_kind"], "_all").filter("_kind = 1")
        early = rank_within(place, ["base"], ["_o", "_kind"], "_mine").select("path", (F.col("_all") - F.col("_mine")).alias("_early"))
        gone = asked.join(early, "path", "left").select("base", "path", "n", (F.col("n") - 1 - F.coalesce("_early", F.lit(0))).alias("less"))
        kind = "base string, path string, n long, passed boolean"
        gone = stash(gone.repartition("base").sortWithinPartitions("base", "n").mapInArrow(_passed_over, kind), "gone")
        stolen = stolen.union(gone.filter("not passed").select("path"))
        taken = rank_within(gone.filter("passed").select("base", "n"), ["base"], ["n"], "_i").select("base", (F.col("n") - 1 - F.col("_i")).alias("_v"), F.lit(False).alias("_claims"))
        ranks = rank_within(more, ["base"], ["_o"], "_v").withColumn("_claims", F.lit(True))
        both = rank_within(taken.unionByName(ranks, allowMissingColumns=True), ["base"], ["_v", "_claims", "_o"], "_number").filter("_claims")
        numbered = both.select(*columns, _numbered(F.col("base"), F.col("_number") + 1).alias("final_path"))
        found = here.filter("_wins").select(*columns, F.col("path").alias("final_path")).unionByName(numbered)
        done = found if done is None else done.unionByName(found)
    return done


_FAMILY = ["_dir", "_stem", "_ext"]


def assign_unique(plan: DataFrame, existing: DataFrame, stashed: bool = False) -> DataFrame:
    """U2. The plan's rows with final_path: the first free of `stem.ext`, `stem (1).ext`, ... in order of (ord, key).

    plan: key, ord, path and any other columns; key is unique. existing: path.
    stashed: the plan is read from a stash, so that it needn't be written again.
    Names without a clash stay. Claimants of one name get the numbers that
    existing files leave free by their rank, in joins and sorts that spread a
    much claimed name over tasks; names that clash with numbered forms of
    others are taken level by level (_assign_mixed()).
    """
    use_package(plan.sparkSession)
    asked = plan if stashed else stash(plan, "asked")
    every = asked.select("path", F.lit(1).alias("_n")).unionByName(existing.filter("path is not null").select("path", F.lit(0).alias("_n")))
    names = every.groupBy("path").agg(F.sum("_n").alias("_n"), F.bool_or(F.col("_n") == 0).alias("_there"))
    names = stash(names.select("*", *family(F.col("path"))), "names")
    wanted = F.col("_n") > 0
    facts = names.groupBy(*_FAMILY).agg(F.min(F.when(wanted, F.col("path"))).alias("_lo"), F.count_if(wanted).alias("_names"), F.max("_n").alias("_most"), F.bool_or(wanted & F.col("_there")).alias("_hit"))
    facts = facts.filter(F.col("_hit") | (F.col("_most") > 1)).select(*_FAMILY, "_lo", (F.col("_names") == 1).alias("_plain"))
    families = stash(names.join(facts, _FAMILY), "families")  # the names of those where some clash
    free = asked.join(families.filter(wanted).select("path"), "path", "left_anti").select(*plan.columns, F.col("path").alias("final_path"))

    numbers = families.filter("_plain and _there").select(*_FAMILY, _number_in(F.col("path"), F.col("_lo")).alias("_n")).filter("_n is not null").withColumn("_claims", F.lit(False))
    claims = asked.join(families.filter(wanted & F.col("_plain")).select("path", *_FAMILY), "path").withColumn("_claims", F.lit(True))
    # One sort ranks a family's claimants by (ord, key) and its taken numbers.
    one = rank_within(claims.unionByName(numbers, allowMissingColumns=True), [*_FAMILY, "_claims"], ["ord", "key", "_n"], "_i")
    # A number n with i taken ones below it is passed by the claimants from rank n - i on.
    placed = one.withColumn("_v", F.when(F.col("_claims"), F.col("_i")).otherwise(F.col("_n") - F.col("_i")))
    both = rank_within(placed, _FAMILY, ["_v", "_claims", "key"], "_number")
    ranked = both.filter("_claims").select(*plan.columns, _numbered(F.col("path"), F.col("_number")).alias("final_path"))

    out, mixed = free.unionByName(ranked), families.filter("not _plain")
    if mixed.isEmpty():
        return out
    return out.unionByName(_assign_mixed(asked.join(mixed.filter(wanted).select("path"), "path", "left_semi"), mixed.filter("_there").select("path"), plan.columns))


def plan_moves(photos: DataFrame, new_status: DataFrame, existing: DataFrame) -> DataFrame:
    """U3. id, role (image, companion), from_path, to_path of rows whose status really changes.

    new_status: id, new_status. A motion clip goes to its image's directory
    with its own suffix; one that isn't on disk (existing: path) stays.
    """
    moved = photos.join(new_status, "id").filter("status <> new_status and source = 'local' and not missing")
    image = moved.select("id", F.col("relative_path").alias("from_path"), dest_path(F.col("relative_path"), F.col("original_path"), F.col("provenance"), F.col("new_status")).alias("path"), F.col("live_photo_video_path").alias("clip"))
    clips = image.filter("coalesce(clip, '') <> ''").join(existing.select(F.col("path").alias("clip")).distinct(), "clip", "left_semi")
    beside = F.when(parent_of("path") == ".", name_of("clip")).otherwise(F.concat_ws("/", parent_of("path"), name_of("clip")))
    rows = image.select("id", F.lit("image").alias("role"), "from_path", "path").unionByName(clips.select("id", F.lit("companion").alias("role"), F.col("clip").alias("from_path"), beside.alias("path")))
    rows = rows.withColumn("key", F.col("id") * 2 + (F.col("role") == "companion").cast("long"))
    named = assign_unique(rows.withColumn("ord", F.col("key")), existing.join(rows.select(F.col("from_path").alias("path")), "path", "left_anti"))
    return named.select("id", "role", "from_path", F.col("final_path").alias("to_path"))


def apply_moves(photos: DataFrame, plan: DataFrame) -> DataFrame:
    """U3. The catalog after a move plan: rows get path, status and provenance of their new place, images their origin and clip's path."""
    by_path = plan.select(F.col("from_path").alias("relative_path"), "to_path")
    by_clip = plan.select(F.col("from_path").alias("live_photo_video_path"), F.col("to_path").alias("clip_to"))
    joined = left_join_sparse(photos.join(by_path, "relative_path", "left"), by_clip, ["live_photo_video_path"], "id")
    moved = F.col("to_path").isNotNull()
    leaves = moved & (F.col("status") == "optional") & (F.coalesce("original_path", F.lit("")) == "")
    new = {
        "relative_path": F.coalesce("to_path", "relative_path"),
        "status": F.when(moved, status_of("to_path")).otherwise(F.col("status")),
        "provenance": F.when(moved, provenance_of("to_path")).otherwise(F.col("provenance")),
        "original_path": F.when(leaves, F.col("relative_path")).otherwise(F.col("original_path")),
        "live_photo_video_path": F.coalesce("clip_to", "live_photo_video_path"),
    }
    return joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in photos.columns))


def plan_flatten(photos: DataFrame, listing: DataFrame, downloaded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """U4. (moves from_path -> to_path, catalog after, downloaded after) for files deeper than one level under selected/. A second run is empty."""
    deep = listing.select("relative_path").filter(F.col("relative_path").rlike(r"^selected/.*/") & ~F.col("relative_path").rlike(r"(^|/)\."))
    flat = listing.select(F.col("relative_path").alias("path")).filter(F.col("path").rlike(r"^selected/[^/]*$"))
    rows = deep.select(F.col("relative_path").alias("key"), F.col("relative_path").alias("ord"), F.concat(F.lit("selected/"), name_of("relative_path")).alias("path"))
    moves = stash(assign_unique(rows, flat).select(F.col("key").alias("from_path"), F.col("final_path").alias("to_path")), "moves")
    by_path, by_clip = moves.toDF("relative_path", "to_path"), moves.toDF("live_photo_video_path", "clip_to")
    joined = left_join_sparse(photos.join(by_path, "relative_path", "left"), by_clip, ["live_photo_video_path"], "id")
    origin = F.when(F.col("to_path").isNotNull() & (F.coalesce("original_path", F.lit("")) == ""), F.regexp_replace("relative_path", "^selected/", "")).otherwise(F.col("original_path"))
    new = {"relative_path": F.coalesce("to_path", "relative_path"), "original_path": origin, "live_photo_video_path": F.coalesce("clip_to", "live_photo_video_path")}
    after = joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in photos.columns))
    landed = downloaded.join(by_path, "relative_path", "left").select(*(F.coalesce("to_path", "relative_path").alias(c) if c == "relative_path" else c for c in downloaded.columns))
    return moves, after, landed


def plan_export(files: DataFrame, photos: DataFrame, dest_listing: DataFrame, date_prefix: bool = False, only: DataFrame | None = None) -> DataFrame:
    """U5, U7. relative_path, action (copy, skip), target of the files under selected/.

    The same name with the same size and a time within two seconds is skipped;
    only the unsuffixed name is looked at. `only` limits to rows with these paths.
    """
    rows = files.select("relative_path", "file_size", "file_mtime").filter(F.col("relative_path").startswith("selected/") & ~F.col("relative_path").rlike(r"(^|/)\."))
    if only is not None:
        rows = rows.join(only.select("relative_path"), "relative_path", "left_semi")
    if date_prefix:
        rows = rows.join(photos.select("relative_path", "captured_at"), "relative_path", "left")
        rows = rows.withColumn("path", export_name(name_of("relative_path"), F.col("captured_at"), True))
    else:
        rows = rows.withColumn("path", name_of("relative_path"))
    there = dest_listing.select(F.col("name").alias("path"), F.col("file_size").alias("_size"), F.col("file_mtime").alias("_mtime"))
    joined = rows.join(there, "path", "left")
    same = F.coalesce((F.col("file_size") == F.col("_size")) & (F.abs(F.col("file_mtime") - F.col("_mtime")) < 2.0), F.lit(False))
    todo = stash(joined.select("relative_path", "path", same.alias("same")), "todo")
    copies = todo.filter("not same").select(F.col("relative_path").alias("key"), F.col("relative_path").alias("ord"), "path")
    named = assign_unique(copies, dest_listing.select(F.col("name").alias("path")), stashed=True)
    out = named.select(F.col("key").alias("relative_path"), F.lit("copy").alias("action"), F.col("final_path").alias("target"))
    return out.unionByName(todo.filter("same").select("relative_path", F.lit("skip").alias("action"), F.col("path").alias("target")))


def refuse_inside(destination: str, library: str) -> None:
    """U5. An export into the library itself is an error."""
    inner, outer = destination.rstrip("/") + "/", library.rstrip("/") + "/"
    if inner.startswith(outer):
        raise ValueError("the destination lies in the library")


def export_report(plan: DataFrame) -> DataFrame:
    """U8."""
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def reconcile_export(photos: DataFrame, ledger: DataFrame, dest_listing: DataFrame) -> DataFrame:
    """U9. target, action: remove copies the job wrote of files no longer selected, flag those modified since, keep the rest.

    ledger: id, name, file_size, file_mtime as written.
    """
    chosen = photos.filter("status = 'selected' and not missing").select("id", F.lit(True).alias("_in"))
    joined = ledger.join(chosen, "id", "left").join(dest_listing.select("name", F.col("file_size").alias("_s"), F.col("file_mtime").alias("_m")), "name", "left")
    same = (F.col("file_size") == F.col("_s")) & (F.abs(F.col("file_mtime") - F.col("_m")) < 2.0)
    action = F.when(F.col("_in") & F.col("_s").isNull(), "restore").when(F.col("_in"), "keep").when(F.col("_s").isNull(), "gone").when(same, "remove").otherwise("modified")
    return joined.select("id", F.col("name").alias("target"), action.alias("action"))


def adopt_statuses(listing: DataFrame) -> DataFrame:
    """U10. source_id, relative_path, status of files in a source's old status folders."""
    return listing.select(F.col("root_id").alias("source_id"), "relative_path", status_of("relative_path").alias("status")).filter("status <> 'optional'")
