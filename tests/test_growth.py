"""What a job reads, keeps and hands on doesn't grow faster than its input."""

from pyspark.sql import functions as F

from photolake import schemas
from photolake.operators import neardup, ranks, scan
from photolake.operators.joins import left_join_sparse
from photolake.plans import moves
from photolake.streaming import jobs
from tests.test_catalog import photo, photos
from tests.test_streams import ARRIVING, at, files


def test_of_a_groups_actions_one_goes_on(spark, tmp_path):
    """300 actions of a batch on two groups are two rows for the next stream."""
    base = str(tmp_path)
    jobs.start_groups(photos(spark, *(photo(i, sha256="ab"[i % 2]) for i in range(1, 9))), base, 4)
    acts = [(k, at(k % 50), 1 + k % 8, ("selected", "rejected")[k % 3 % 2]) for k in range(300)]
    jobs.key_actions(files(spark, acts, schemas.ACTIONS, base, 0), base, f"{base}/keyed", f"{base}/check", 4).awaitTermination()
    got = {r.group: (r.photo_id, r.status, r.action_id) for r in spark.read.parquet(f"{base}/keyed/batch=0").collect()}
    last = lambda g: max((k[1], k[0], k[2], k[3]) for k in acts if "ab"[k[2] % 2] == g)
    assert got == {g: (last(g)[2], last(g)[3], last(g)[1]) for g in "ab"} and spark.read.parquet(f"{base}/keyed/batch=0").count() == 2


def test_streams_are_dealt_into_files_by_their_rows(spark, tmp_path, monkeypatch):
    """As many batches as ever, of more files where there are more rows."""
    from photolake.plans import queries

    monkeypatch.setattr(queries, "FILE_ROWS", 100)
    rows = spark.range(1000)
    stream = queries._as_stream(spark, rows, str(tmp_path), "id")
    sizes = [spark.read.parquet(str(f)).count() for f in tmp_path.glob("in/*.parquet")]
    assert len(sizes) == 12 and max(sizes) < 200 and sum(sizes) == 1000
    seen = []
    stream.writeStream.foreachBatch(lambda b, n: seen.append(b.count())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == queries.FILES and sum(seen) == 1000


def test_a_pull_leaves_known_rows_where_they_are(spark):
    """The catalog is neither joined nor dealt out anew where only rows are added."""
    known = photos(spark, photo(1), photo(2))
    new = photos(spark, photo(3, relative_path="new.jpg"))
    out = scan.upsert_catalog(known, new.unionByName(new.filter("false")), "relative_path", [], 2)
    assert sorted((r.id, r.relative_path) for r in out.collect()) == sorted([*((r.id, r.relative_path) for r in known.collect()), (3, "new.jpg")])
    assert "_hit" not in out._jdf.queryExecution().analyzed().toString()


def test_rows_without_a_key_are_dealt_out(spark):
    """Nine of ten rows have no key; a join must not bring them to one task."""
    rows = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).alias("k"))
    right = spark.range(0, 4000, 20).select(F.col("id").cast("string").alias("k"), F.lit(True).alias("hit"))
    out = left_join_sparse(rows, right.unionByName(right.select(F.lit(None).cast("string").alias("k"), "hit").limit(1)).hint("merge"), ["k"], "id")
    assert sorted(out.columns) == ["hit", "id", "k"]
    got = {r.id: (r.k, r.hit) for r in out.collect()}
    assert out.count() == len(got) == 4000 and all(got[i] == (str(i) if i % 10 == 0 else None, True if i % 20 == 0 else None) for i in got)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 2000


def test_known_photos_are_not_compared_with_each_other(spark):
    """Pairs with a new photo, without any join on the pairs found."""
    every = [photo(i, phash=f"{i % 3:016x}", captured_at=at(i % 19)) for i in range(60)]
    fresh, known = photos(spark, *every[::3]), photos(spark, *(x for i, x in enumerate(every) if i % 3))
    found = neardup.near_duplicates_of(fresh, known)
    ids = {r.id for r in fresh.collect()}
    want = sorted(tuple(r) for r in neardup.near_duplicates(fresh.unionByName(known)).collect() if r.photo_a in ids or r.photo_b in ids)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 100


def test_a_listing_writes_its_changes_alone(spark, tmp_path):
    """Files that stay as they are cost a batch no write, and the catalog's own partitions stay in place."""
    base = str(tmp_path)
    start = photos(spark, *(photo(i, relative_path=f"p{i}.jpg", file_size=i) for i in range(1, 401)))
    jobs.start_catalog(start, base, 4)
    before = {f: f.stat().st_mtime_ns for f in tmp_path.glob("photos/*/*.parquet")}
    mtime = start.first().file_mtime
    rows = [(f"p{i}.jpg", i, mtime + (9 if i < 4 else 0), at(0), "exif", None, None, None) for i in range(1, 402)]
    jobs.stream_listing(files(spark, rows, ARRIVING, base, 0), base, start, f"{base}/check", 4).awaitTermination()
    assert {f: f.stat().st_mtime_ns for f in tmp_path.glob("photos/*/*.parquet")} == before
    assert sorted(r.relative_path for r in spark.read.parquet(f"{base}/changes").collect()) == ["p1.jpg", "p2.jpg", "p3.jpg", "p401.jpg"]
    got = {r.id: r for r in jobs.read_catalog(spark, base, start).collect()}
    assert len(got) == 401 and got[401].relative_path == "p401.jpg" and [i for i in got if got[i].file_mtime != mtime] == [1, 2, 3]


def test_an_export_plan_reads_its_files_once(spark):
    """Neither the branch of skipped files nor the naming compares the files anew, and no dates are looked up that no name bears."""
    read = {k: spark.sparkContext.accumulator(0) for k in ("files", "photos")}

    def counted(rows, k):
        acc = read[k]

        def note(batches):
            for b in batches:
                acc.add(b.num_rows)
                yield b

        return rows.mapInArrow(note, rows.schema)

    f = spark.range(300).select(F.concat(F.lit("selected/"), F.col("id").cast("string"), F.lit(".jpg")).alias("relative_path"), F.col("id").alias("file_size"), F.lit(5.0).alias("file_mtime"), F.lit(None).cast("timestamp").alias("captured_at"))
    there = spark.range(200).select(F.concat(F.col("id").cast("string"), F.lit(".jpg")).alias("name"), F.when(F.col("id") < 100, F.col("id")).otherwise(-1).alias("file_size"), F.lit(5.5).alias("file_mtime"))
    got = {r.relative_path: (r.action, r.target) for r in moves.plan_export(counted(f, "files"), counted(f, "photos"), there).collect()}
    want = lambda i: ("skip", f"{i}.jpg") if i < 100 else ("copy", f"{i} (1).jpg" if i < 200 else f"{i}.jpg")
    assert got == {f"selected/{i}.jpg": want(i) for i in range(300)}
    assert (read["files"].value, read["photos"].value) == (300, 0)


def test_ranks_go_on_from_one_partition_to_the_next(spark):
    """A group of most rows, one of nulls and small ones; of the others than a partition's outer ones no sizes are gathered."""
    group = lambda i: "m" if i % 10 < 6 else None if i % 10 == 6 else f"{i % 97:02}"
    data = [(group(i), i % 2 == 0, (i * 7919) % 5000) for i in range(5000)]
    out = ranks.rank_within(spark.createDataFrame(data, "g string, even boolean, o long").repartition(5), ["g", "even"], ["o"], "n")
    seen = {}
    for g, even, o in sorted(data, key=lambda r: r[2]):
        seen.setdefault((g, even), []).append(o)
    assert {(r.g, r.even, r.o): r.n for r in out.collect()} == {(*k, o): n for k, os in seen.items() for n, o in enumerate(os)}
    assert "_end_0" in out._jdf.queryExecution().analyzed().toString()
