"""Streams: batches in any order, batches run again, and what a batch reads."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from photolake import schemas
from photolake.operators import scan
from photolake.operators.decisions import fold_actions
from photolake.streaming import jobs, parts
from tests.test_catalog import T0, photo, photos

at = lambda s: T0 + timedelta(seconds=s)
ARRIVING = "relative_path string, file_size long, file_mtime double, captured_at timestamp, captured_at_source string, sha256 string, snapshot string, total long"


def files(spark, rows, schema, base, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/{name}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")


def pairs_of(spark, base):
    return sorted((r.photo_a, r.photo_b) for r in spark.read.parquet(f"{base}/pairs").collect())


def test_pairs_across_batches_days_and_reruns(spark, tmp_path):
    base = str(tmp_path)
    midnight = T0.replace(hour=23, minute=59, second=58)
    same = {"phash": "0" * 16}
    batches = [[photo(1, **same)], [photo(2, **same, captured_at=at(3))], [photo(2, **same, captured_at=at(3))], [photo(4, **same, captured_at=midnight + timedelta(seconds=4))], [photo(3, **same, captured_at=midnight), photo(5, **same, captured_at=None)]]
    for n, rows in enumerate(batches):
        stream = files(spark, rows, schemas.PHOTOS, base, n)
        jobs.stream_near_duplicates(stream, base, f"{base}/check").awaitTermination()
    assert pairs_of(spark, base) == [(1, 2), (3, 4)]
    days = {x for x in parts.partition_names(spark, f"{base}/seen")}
    assert days == {"day=2025-06-14", "day=2025-06-15"}


def test_decisions_out_of_order_equal_the_batch_fold(spark, tmp_path):
    base = str(tmp_path)
    start = photos(spark, *(photo(i, sha256="abc"[i % 3] if i < 20 else None, missing=i == 7, relative_path=f"@src/1/{i}.jpg" if i == 8 else f"p/{i}.jpg") for i in range(1, 26)))
    acts = [(k, at((k * 37) % 40), 1 + (k * 11) % 30, ("selected", "rejected", "optional", "junk")[k % 4]) for k in range(40)]
    jobs.start_groups(start, base, 4)
    keyed = f"{base}/keyed"
    for n in range(4):
        stream = files(spark, acts[n::4], schemas.ACTIONS, base, n)
        jobs.key_actions(stream, base, keyed, f"{base}/check-1", 4).awaitTermination()
        rows = spark.readStream.schema(jobs.KEYED).parquet(f"{keyed}/*")
        jobs.stream_decisions(rows, base, start, f"{base}/check-2", 4).awaitTermination()
    want = {r.id: r.status for r in fold_actions(start, spark.createDataFrame(acts, schemas.ACTIONS)).collect()}
    assert {r.id: r.status for r in jobs.read_catalog(spark, base, start).collect()} == want


def test_a_batch_reads_its_own_partitions(spark, tmp_path):
    """However large the table is: the plan has partition filters, and few files are read."""
    base = str(tmp_path)
    start = photos(spark, *(photo(i) for i in range(400)))
    jobs.start_catalog(start, base, 32)
    key = parts.bucket_of("relative_path", buckets=32)
    wanted = parts.values(start.filter("id in (5, 6)"), key)
    part = parts.read_parts(spark, f"{base}/photos", start.withColumn("bucket", F.lit(0)), "bucket", wanted)
    files_read = part.select(F.input_file_name()).distinct().count()
    assert files_read == len(wanted) <= 2 < len(parts.partition_names(spark, f"{base}/photos"))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert part.filter("id in (5, 6)").count() == 2


def test_replaced_partitions_survive_a_crash(spark, tmp_path, monkeypatch):
    """A batch that broke off while it put its rows in place is completed from what was written aside."""
    path = f"{tmp_path}/t"
    parts.write_parts(spark.range(40).withColumn("bucket", (F.col("id") % 4).cast("int")).withColumn("v", F.lit(0)), path, "bucket")
    grown = lambda: parts.read_parts(spark, path, spark.createDataFrame([], "id long, bucket int, v int"), "bucket", [1, 2]).withColumn("v", F.col("v") + 1)
    monkeypatch.setattr(parts, "values", lambda *a: 1 / 0)  # after the rows are in place
    with pytest.raises(ZeroDivisionError):
        parts.replace_parts(spark, path, 0, grown, "bucket", whole=True)
    monkeypatch.undo()
    parts.remove(spark, f"{path}/bucket=1")  # as if it had broken off within the swap
    parts.replace_parts(spark, path, 0, grown, "bucket")
    got = {(r.bucket, r.v, r.n) for r in spark.read.parquet(path).groupBy("bucket", "v").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(0, 0, 10), (1, 1, 10), (2, 1, 10), (3, 0, 10)}
    parts.replace_parts(spark, path, 1, grown, "bucket")
    assert parts.partition_names(spark, f"{path}-written") == ["batch=000000000001-0000"]


def _listed(paths, snapshot=None):
    return [(p, size, mtime, T0, "exif", sha, snapshot, None) for p, size, mtime, sha in paths]


def test_snapshots_equal_batch_scans(spark, tmp_path):
    base = str(tmp_path)
    start = photos(spark, photo(1, relative_path="a.jpg", file_size=1, sha256="x"), photo(2, relative_path="b.jpg", file_size=2), photo(3, relative_path="c.jpg", file_size=3), photo(4, relative_path="d.jpg", file_size=4), photo(9, relative_path="@icloud/k/r", source="icloud", account="k", remote_id="r"))
    m = 1700000000.0
    one = [("selected/a.jpg", 1, m, "x"), ("other.jpg", 1, m, "y"), ("b.jpg", 2, m + 9, None), ("c2.jpg", 3, m, None), ("c3.jpg", 3, m, None), ("d.jpg", 4, m, None)]
    two = [("selected/a.jpg", 1, m, "x"), ("b.jpg", 2, m + 9, None), ("c.jpg", 3, m, None), ("new/d.jpg", 4, m, None)]
    jobs.start_catalog(start, base, 4)
    arrivals = [_listed(one[:3], "1"), [*_listed(two[:2], "2"), (None, None, None, None, None, None, "2", len(two))], _listed(one[3:], "1"), [(None, None, None, None, None, None, "1", len(one))], _listed(two[2:], "2")]
    for n, rows in enumerate(arrivals):
        stream = files(spark, rows, ARRIVING, base, n)
        jobs.stream_listing(stream, base, start, f"{base}/check", 4).awaitTermination()
    want = start
    for rows in (one, two):
        want = scan.scan_library(want, spark.createDataFrame(_listed(rows), ARRIVING).drop("snapshot", "total"))
    shown = lambda df: sorted((r.relative_path, r.missing, r.status, r.file_mtime) for r in df.collect())
    got = jobs.read_catalog(spark, base, start)
    assert shown(got) == shown(want)
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == got.count()
    assert rows[1].relative_path == "selected/a.jpg" and rows[1].status == "selected" and not rows[1].missing
    assert rows[3].relative_path == "c.jpg" and rows[4].relative_path == "new/d.jpg" and rows[9].source == "icloud"


def test_pull_of_old_items_keeps_ids_unique(spark, tmp_path):
    base = str(tmp_path)
    start = photos(spark, photo(5))
    none = spark.createDataFrame([], "account string, remote_id string, relative_path string")
    named = spark.createDataFrame([("k", "r2", "rejected")], "account string, remote_id string, status string")
    jobs.start_catalog(start, base, 4)
    jobs.start_remote_state(none, named, base, 4)
    item = lambda i, day: ("k", i, f"r{i}", f"n{i}", T0 - timedelta(days=day), 3, "image", False)
    for n, rows in enumerate([[item(1, 0), item(2, 1)], [item(1, 0), item(3, 900)], [item(3, 900)]]):
        stream = files(spark, rows, schemas.REMOTE_LISTING, base, n)
        jobs.stream_pull(stream, base, start, none, named, f"{base}/check", 4).awaitTermination()
    got = jobs.read_catalog(spark, base, start).collect()
    assert sorted((r.id, r.remote_id, r.status) for r in got if r.remote_id) == [(6, "r1", "optional"), (7, "r2", "rejected"), (8, "r3", "optional")]


def test_bounded_pairs(spark, tmp_path):
    base = str(tmp_path)
    stream = files(spark, [photo(1, phash="0" * 16), photo(2, phash="0" * 15 + "7", captured_at=at(4)), photo(3, phash="f" * 16, captured_at=at(5))], schemas.PHOTOS, base, 0)
    found = jobs.stream_near_duplicates_bounded(stream, "1 hour")
    found.writeStream.format("parquet").option("path", f"{base}/pairs").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.read.schema(found.schema).parquet(f"{base}/pairs").collect()] == [(1, 2, 3)]


def test_changes_beside_the_catalog_equal_batch_listings(spark, tmp_path):
    """New files, changed ones, changed again, of rows that were missing or another source's; folded in after two batches, and a batch run again."""
    base = str(tmp_path)
    start = photos(spark, *(photo(i, relative_path=f"p{i}.jpg", file_size=i, file_mtime=0.0, missing=i % 5 == 0, source_ref=1 if i % 4 == 0 else None) for i in range(1, 13)))
    jobs.start_catalog(start, base, 4)
    want, shown = start, lambda df: sorted(tuple(r) for r in df.collect())
    for n in range(5):
        rows = [(f"{'selected/' if i % 3 == n % 3 else ''}p{i}.jpg", i, float(i * n % 3), at(n), "exif", None, None, None) for i in range(n, n + 9)]
        stream = files(spark, rows, ARRIVING, base, n)
        jobs.stream_listing(stream, base, start, f"{base}/check", 4, fold=2).awaitTermination()
        want = scan.apply_listing(want, spark.createDataFrame(rows, ARRIVING)).localCheckpoint()
        got = jobs.read_catalog(spark, base, start)
        assert shown(got) == shown(want) and got.columns == want.columns
        if n in (3, 4):  # one that folded, one that didn't
            for name in (f"{n}", f".{n}.crc"):
                (tmp_path / "check/commits" / name).unlink()
            jobs.stream_listing(stream, base, start, f"{base}/check", 4, fold=2).awaitTermination()
            assert shown(jobs.read_catalog(spark, base, start)) == shown(want)
    assert parts.partition_names(spark, f"{base}/folded") == ["batch=1", "batch=3"]
    assert parts.partition_names(spark, f"{base}/changes") == ["batch=4"]


def test_a_file_listed_twice_in_a_batch_is_one_row(spark, tmp_path):
    base = str(tmp_path)
    start = photos(spark, photo(1, relative_path="a.jpg"))
    jobs.start_catalog(start, base, 4)
    rows = [(p, size, 1.8e9 + size, T0, "exif", None, None, None) for p in ("a.jpg", "b.jpg") for size in (1, 3, 2)]
    jobs.stream_listing(files(spark, rows, ARRIVING, base, 0), base, start, f"{base}/check", 4).awaitTermination()
    assert sorted((r.id, r.relative_path, r.file_size) for r in jobs.read_catalog(spark, base, start).collect()) == [(1, "a.jpg", 3), (2, "b.jpg", 3)]
