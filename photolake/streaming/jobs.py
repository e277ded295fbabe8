"""Streaming forms of the catalog jobs.

Tables are plain Parquet in partitions (see parts.py), of which a batch reads
and replaces those that its own rows touch. A batch that is run again gives the
same rows and loses nothing, however late its input is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from photolake.functions.paths import remote_sentinel
from photolake.operators.decisions import group_key, validate_actions
from photolake.operators.neardup import WINDOW_S, near_duplicates_of
from photolake.operators.scan import LISTED_COLS, listed_changes, scan_library, with_changes
from photolake.session import remove, scratch, stash, use_package
from photolake.sources.remote import pull
from photolake.streaming.parts import BUCKETS, bucket_of, exists, partition_names, read_parts, replace_parts, values, write_parts

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000


def _run(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    def in_scratch(rows: DataFrame, n: int) -> None:
        with scratch(rows.sparkSession):
            step(rows, n)

    return stream.writeStream.foreachBatch(in_scratch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _seen_ids(spark: SparkSession, base: str, n: int) -> int:
    """The largest id given before a batch: one small row a batch."""
    return spark.read.parquet(f"{base}/top").filter(F.col("batch") < n).agg(F.max("top")).first()[0]


def _most(top: int, written: DataFrame) -> int:
    return max(top, written.agg(F.max("id")).first()[0] or 0)


def _note_ids(spark: SparkSession, base: str, n: int, top: int) -> None:
    spark.createDataFrame([(top,)], "top long").write.mode("overwrite").parquet(f"{base}/top/batch={n}")


def start_catalog(photos: DataFrame, base: str, buckets: int = BUCKETS) -> None:
    """The catalog by path for stream_pull() and stream_listing(), with the largest id noted beside it."""
    keyed = photos.select("*", bucket_of("relative_path", buckets=buckets).alias("bucket"))
    write_parts(keyed, f"{base}/photos", "bucket")
    photos.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).write.parquet(f"{base}/top/batch=-1")


def start_remote_state(downloaded: DataFrame, decisions: DataFrame, base: str, buckets: int = BUCKETS) -> None:
    """An accounts' state in the same partitions as their catalog rows."""
    for name, rows in (("downloaded", downloaded), ("decisions", decisions)):
        write_parts(rows.select("*", bucket_of(remote_sentinel(F.col("account"), F.col("remote_id")), buckets=buckets).alias("bucket")), f"{base}/{name}", "bucket")


def stream_pull(listing: DataFrame, base: str, photos: DataFrame, downloaded: DataFrame, decisions: DataFrame, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """W1. Listing pages as they arrive; items of any age come in, each once. No watermark: it would lose late ones.

    base: what start_catalog() and start_remote_state() wrote; the other
    tables only tell its columns. A batch reads the partitions of its items.
    """
    spark, key = listing.sparkSession, bucket_of("relative_path", buckets=buckets).alias("bucket")
    shaped = {"photos": photos.select("*", key), "downloaded": downloaded.withColumn("bucket", F.lit(0)), "decisions": decisions.withColumn("bucket", F.lit(0))}

    def step(rows: DataFrame, n: int) -> None:
        wanted = values(rows, bucket_of(remote_sentinel(F.col("account"), F.col("remote_id")), buckets=buckets))
        part = lambda name: read_parts(spark, f"{base}/{name}", shaped[name], "bucket", wanted).drop("bucket")
        top = _seen_ids(spark, base, n)
        done = replace_parts(spark, f"{base}/photos", n, lambda: pull(part("photos"), rows, part("downloaded"), part("decisions"), top).select("*", key), "bucket", placed=True)
        _note_ids(spark, base, n, _most(top, done))

    return _run(listing, checkpoint, step)


def read_catalog(spark: SparkSession, base: str, photos: DataFrame) -> DataFrame:
    return with_changes(spark.read.schema(photos.schema).parquet(f"{base}/photos").select(*photos.columns), _changes(spark, base, photos))


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(x.partition("=")[2]) for x in partition_names(spark, path))


def _unfolded(spark: SparkSession, base: str) -> list[int]:
    """Batches whose changes lie beside the catalog only."""
    folded = max(_numbers(spark, f"{base}/folded"), default=-1)
    return [n for n in _numbers(spark, f"{base}/changes") if n > folded]


def _changes(spark: SparkSession, base: str, photos: DataFrame, last: int | None = None, wanted: list | None = None) -> DataFrame | None:
    """What stream_listing() has changed up to a batch and not folded in yet, the latest of each path; of the wanted buckets alone."""
    batches = [n for n in _unfolded(spark, base) if last is None or n <= last]
    if not batches:
        return None
    kind = photos.select("relative_path", *LISTED_COLS, "id", F.lit(0).alias("batch"), F.lit(0).alias("bucket")).schema
    rows = spark.read.schema(kind).option("basePath", f"{base}/changes").parquet(*(f"{base}/changes/batch={n}" for n in batches))
    rows = rows if wanted is None else rows.filter(F.col("bucket").isin(wanted))
    return rows.groupBy("relative_path").agg(*(F.max_by(c, "batch").alias(c) for c in LISTED_COLS), F.max("id").alias("id"))


class LastAction(StatefulProcessor):
    """A group's last action in the state store: (ts, action_id), photo and status. Gives a row whenever an action is later than the one known."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long, action_id long, photo_id long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.last.get() if self.last.exists() else None
        best = known
        for part in rows:
            for one in zip(part.us, part.action_id, part.photo_id, part.status, strict=True):
                best = max(best, one) if best else one
        if best != known:
            best = (int(best[0]), int(best[1]), int(best[2]), str(best[3]))
            self.last.update(best)
            yield pd.DataFrame([(key[0], *best)], columns=["group", "us", "action_id", "photo_id", "status"])

    def close(self) -> None:
        pass


def start_groups(photos: DataFrame, base: str, buckets: int = BUCKETS) -> None:
    """The catalog by group for stream_decisions(), and beside it each photo's group by id."""
    write_parts(photos.select("*", bucket_of(group_key(), buckets=buckets).alias("bucket")), f"{base}/photos", "bucket")
    index = photos.select("id", "missing", "relative_path", group_key().alias("group"), bucket_of("id", buckets=buckets).alias("bucket"))
    write_parts(index, f"{base}/index", "bucket")


def key_actions(actions: DataFrame, base: str, out: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """W2, first half. Each group's last action of those that can be applied, as files under `out`; a batch reads the index of its own photos.

    The others of a batch change nothing, so they go no further: what is written
    grows with the groups a batch reaches, not with its actions.
    """
    spark = actions.sparkSession

    def step(rows: DataFrame, n: int) -> None:
        wanted = values(rows, bucket_of("photo_id", buckets=buckets))
        index = spark.read.parquet(f"{base}/index").filter(F.col("bucket").isin(wanted) if wanted else F.lit(False))
        ok, _ = validate_actions(rows, index)
        keyed = ok.join(index.select(F.col("id").alias("photo_id"), "group"), "photo_id")
        us = F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 62)))
        last = keyed.select("group", F.struct(us.alias("us"), "action_id", "photo_id", "status").alias("x")).groupBy("group").agg(F.max("x").alias("x"))
        last.select("group", "x.*").write.mode("overwrite").parquet(f"{out}/batch={n}")

    return _run(actions, checkpoint, step)


KEYED = "group string, us long, action_id long, photo_id long, status string"


def last_actions(keyed: DataFrame) -> DataFrame:
    """W2. A stream of the groups whose last action has changed. Late older actions change nothing."""
    use_package(keyed.sparkSession)
    keyed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return keyed.groupBy("group").transformWithStateInPandas(LastAction(), KEYED, "Update", "None")


def stream_decisions(keyed: DataFrame, base: str, photos: DataFrame, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """W2, second half. The catalog after the actions that key_actions() has written; a batch reads and replaces the partitions of the groups it changes.

    Only a group's last action counts, as in fold_actions(), so the order of arrival doesn't matter.
    """
    spark = keyed.sparkSession
    shaped = photos.withColumn("bucket", F.lit(0))

    def step(rows: DataFrame, n: int) -> None:
        rows = rows.groupBy("group").agg(F.max_by(F.struct("photo_id", "status"), F.struct("us", "action_id")).alias("_last"))
        wanted = values(rows, bucket_of("group", buckets=buckets))

        def folded() -> DataFrame:
            own = read_parts(spark, f"{base}/photos", shaped, "bucket", wanted).withColumn("group", group_key())
            joined = own.join(rows, "group", "left")
            actor = F.col("id") == F.col("_last.photo_id")
            follows = F.col("_last").isNotNull() & ~actor & ~F.col("missing") & ~F.col("relative_path").startswith("@src/")
            status = F.when(actor, F.col("_last.status")).when(follows, "rejected").otherwise(F.col("status"))
            departs = (F.col("status") == "optional") & (status != "optional") & (F.coalesce("original_path", F.lit("")) == "") & (F.col("source") == "local")
            new = {"status": status, "original_path": F.when(departs, F.col("relative_path")).otherwise(F.col("original_path"))}
            return joined.select(*(new[c].alias(c) if c in new else c for c in (*photos.columns, "bucket")))

        replace_parts(spark, f"{base}/photos", n, folded, "bucket")

    return _run(last_actions(keyed), checkpoint, step)


def _day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def stream_near_duplicates(photos: DataFrame, base: str, checkpoint: str, window_s: int = WINDOW_S) -> StreamingQuery:
    """W3. New photos against each other and against known ones shot within the window; exact for any lateness, a rerun adds nothing.

    base/seen holds photos by day and batch, of which the days that a batch
    reaches are read; base/pairs gets a partition a batch, and no pair twice, as
    one photo of each is new.
    """
    spark = photos.sparkSession
    shaped = spark.createDataFrame([], photos.schema).select("*", F.lit("").alias("day"), F.lit(0).alias("batch"))
    width = F.expr(f"interval {window_s} seconds")

    def step(rows: DataFrame, n: int) -> None:
        days = values(rows.filter("captured_at is not null").select(F.explode(F.array("captured_at", F.col("captured_at") - width, F.col("captured_at") + width)).alias("t")), _day("t"))
        have = partition_names(spark, f"{base}/seen")
        near = [x for x in days if f"day={x}" in have]
        known = read_parts(spark, f"{base}/seen", shaped, "day", near).filter(F.col("batch") < n) if near else shaped
        known = known.drop("day", "batch")
        fresh = stash(rows.dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti").select(*photos.columns), "fresh")
        found = near_duplicates_of(fresh, known, window_s)
        found.withColumn("resolved", F.lit(False)).write.mode("overwrite").parquet(f"{base}/pairs/batch={n}")
        placed = fresh.filter("captured_at is not null").select("*", _day("captured_at").alias("day"), F.lit(n).alias("batch"))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{base}/seen")

    return _run(photos, checkpoint, step)


def stream_near_duplicates_bounded(photos: DataFrame, lateness: str = "1 minute", window_s: int = WINDOW_S, max_hamming: int = 8) -> DataFrame:
    """W3 with bounded state: a stream-stream join. Rows later than the watermark are dropped, unlike above."""
    from photolake.functions.hashing import phash_bits

    rows = photos.filter("not missing and source = 'local'").withColumn("bits", phash_bits(F.col("phash"))).filter("bits is not null").withWatermark("captured_at", lateness)
    bucket = F.floor(F.unix_micros("captured_at") / (window_s * MICROS))
    a = rows.select(F.explode(F.array(bucket, bucket + 1)).alias("bucket"), F.col("id").alias("a"), F.col("captured_at").alias("a_ts"), F.col("sha256").alias("a_sha"), F.col("bits").alias("a_bits"))
    b = rows.select(bucket.alias("bucket2"), F.col("id").alias("b"), F.col("captured_at").alias("b_ts"), F.col("sha256").alias("b_sha"), F.col("bits").alias("b_bits"))
    near = F.expr(f"bucket = bucket2 and b_ts >= a_ts and b_ts <= a_ts + interval {window_s} seconds and (b_ts > a_ts or b > a)")
    distance = F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits")))
    same = F.coalesce(F.col("a_sha") == F.col("b_sha"), F.lit(False))
    return a.join(b, near).filter(~same & (distance <= max_hamming)).select(F.least("a", "b").alias("photo_a"), F.greatest("a", "b").alias("photo_b"), distance.cast("short").alias("hamming_distance"))


LISTED = ["relative_path", "file_size", "file_mtime", "captured_at", "captured_at_source", "sha256"]


#: Batches of changes that lie beside the catalog before they are folded into the partitions they belong to.
FOLD = 16


def stream_listing(listing: DataFrame, base: str, photos: DataFrame, checkpoint: str, buckets: int = BUCKETS, fold: int = FOLD) -> StreamingQuery:
    """W4. Files of one root as they are listed. base: what start_catalog() wrote.

    Rows without a snapshot are new and changed files: a batch compares them
    with the partitions of their paths, by the columns that tell a change, and
    writes what is new or changed under base/changes, where read_catalog() finds
    it. Once `fold` batches lie there, the next one replaces the partitions they
    belong to. A file listed twice in a batch counts as modified last. Rows of a snapshot (a name, in the
    order of their making) wait under base/listed until the snapshot's marker, a
    row without a path but with their number in `total`, has come and all of
    them are there. The catalog then takes the snapshot as a scan: changes,
    moved and vanished files. That reads all rows, as the snapshot lists them all.
    """
    spark, key = listing.sparkSession, bucket_of("relative_path", buckets=buckets).alias("bucket")
    shaped = photos.select("*", key)

    def complete(n: int) -> list[str]:
        marks = spark.read.schema("snapshot string, total long, batch int").option("basePath", f"{base}/marks").parquet(f"{base}/marks").filter(F.col("batch") <= n)
        done = spark.read.schema("snapshot string, batch int").option("basePath", f"{base}/done").parquet(f"{base}/done").filter(F.col("batch") < n)
        waiting = marks.groupBy("snapshot").agg(F.max("total").alias("total")).join(done, "snapshot", "left_anti").collect()  # a row a snapshot
        return sorted(r.snapshot for r in waiting if r.total == listed(r.snapshot, n).count())

    def listed(snapshot: str, n: int) -> DataFrame:
        rows = spark.read.schema(listing.select(*LISTED, "snapshot").withColumn("batch", F.lit(0)).schema).option("basePath", f"{base}/listed").parquet(f"{base}/listed")
        return rows.filter((F.col("snapshot") == snapshot) & (F.col("batch") <= n)).select(*LISTED)

    def fold_in(n: int) -> None:
        before = [k for k in _unfolded(spark, base) if k < n]
        if len(before) >= fold:
            touched = sorted({b for k in before for b in _numbers(spark, f"{base}/changes/batch={k}")})
            part = read_parts(spark, f"{base}/photos", shaped, "bucket", touched).drop("bucket")
            replace_parts(spark, f"{base}/photos", n, lambda: with_changes(part, _changes(spark, base, photos, n - 1)).select("*", key), "bucket")
            note_folded(n - 1)
        for k in _numbers(spark, f"{base}/changes"):
            if k < n and k not in _unfolded(spark, base):
                remove(spark, f"{base}/changes/batch={k}")

    def note_folded(n: int) -> None:
        spark.createDataFrame([(n,)], "last long").coalesce(1).write.mode("overwrite").parquet(f"{base}/folded/batch={n}")

    def step(rows: DataFrame, n: int) -> None:
        top = _seen_ids(spark, base, n)
        loose = rows.filter("snapshot is null and relative_path is not null").select(*LISTED)
        wanted = values(loose, key)
        fold_in(n)
        if wanted:
            own = f"{base}/changes/batch={n}"
            if not exists(spark, f"{own}/_SUCCESS"):
                part = read_parts(spark, f"{base}/photos", shaped, "bucket", wanted)
                rest = [c for c in LISTED if c not in ("relative_path", "file_mtime", "sha256")]
                once = loose.groupBy("relative_path").agg(F.max(F.struct("file_mtime", *rest)).alias("x")).select("relative_path", "x.*")
                found = listed_changes(part, _changes(spark, base, photos, n - 1, wanted), once, top)
                found.select("*", key).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(own)
            top = _most(top, spark.read.schema("id long").parquet(own))
        held = rows.filter("snapshot is not null and relative_path is not null").select(*LISTED, "snapshot", F.lit(n).alias("batch"))
        held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot", "batch").parquet(f"{base}/listed")
        rows.filter("snapshot is not null and relative_path is null").select("snapshot", "total").write.mode("overwrite").parquet(f"{base}/marks/batch={n}")
        names = complete(n)
        for turn, name in enumerate(names, 1):
            every = with_changes(spark.read.schema(shaped.schema).parquet(f"{base}/photos").drop("bucket"), _changes(spark, base, photos, n))
            done = replace_parts(spark, f"{base}/photos", n, lambda every=every, name=name, top=top: scan_library(every, listed(name, n), top).select("*", key), "bucket", turn=turn, whole=True)
            top = _most(top, done)
            note_folded(n)
        spark.createDataFrame([(x,) for x in names], "snapshot string").write.mode("overwrite").parquet(f"{base}/done/batch={n}")
        _note_ids(spark, base, n, top)

    for name, kind in (("listed", listing.select(*LISTED, "snapshot").withColumn("batch", F.lit(0)).schema), ("marks", "snapshot string, total long, batch int"), ("done", "snapshot string, batch int")):
        if not exists(spark, f"{base}/{name}"):  # a first partition, so that there is something to read
            by = ("snapshot", "batch") if name == "listed" else ("batch",)
            first = spark.createDataFrame([], kind)
            first.write.partitionBy(*by).parquet(f"{base}/{name}")
    return _run(listing, checkpoint, step)


def stream_daily_counts(photos: DataFrame, lateness: str = "7 days") -> DataFrame:
    """W5. Number of photos a day, updated as they arrive."""
    day = F.window("captured_at", "1 day")
    return photos.withWatermark("captured_at", lateness).groupBy(day).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "n")
