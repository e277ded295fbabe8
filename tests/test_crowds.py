"""Crowded buckets of near duplicates, disconnecting, observed reports, preview keys."""

import random
from datetime import timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from photolake.functions import hashing
from photolake.operators import audit, neardup
from photolake.plans import queries
from photolake.sources import remote
from tests.test_catalog import T0, photo, photos


def _burst(n, seed=1):
    r = random.Random(seed)
    rows, bases = [], [r.getrandbits(64) for _ in range(4)]
    for i in range(n):
        bits = r.choice(bases)
        for b in r.sample(range(64), r.choice([0, 0, 1, 3, 5, 8, 9, 12])):
            bits ^= 1 << b
        when = T0 + timedelta(seconds=r.choice([0, 0, 0, 0.5, 3, 7.9, 8, 8.1, 400]))
        rows.append(photo(i, phash=f"{bits:016x}", captured_at=when, sha256=r.choice([None, "", "x", "y", f"s{i}"]), missing=i % 17 == 0))
    return rows + [photo(9000, phash=None), photo(9001, phash="zz")]


@pytest.mark.parametrize("hot", [0, 10**9])
def test_crowds_have_exact_links(spark, hot):
    p = photos(spark, *_burst(260)).repartition(5)
    want = sorted(tuple(r) for r in neardup.near_duplicates(p).collect())
    members, links = neardup.near_duplicate_classes(p, hot=hot)
    assert sorted(tuple(r) for r in neardup.pairs_of_classes(members, links).collect()) == want and len(want) > 300
    rows = links.collect()
    assert len({tuple(r)[:4] for r in rows}) == len(rows)
    by_id = {r.id: r for r in p.collect()}
    for a, b, d in want:
        x, y = by_id[a], by_id[b]
        assert bin(int(x.phash, 16) ^ int(y.phash, 16)).count("1") == d <= 8 and abs(x.captured_at - y.captured_at) <= timedelta(seconds=8)


def test_a_crowd_at_one_instant_is_one_class(spark):
    """60,000 photos of one time and hash are one class with a link to itself; another hash has a class of its own."""
    rows = spark.range(60_000).selectExpr("id", "cast('1970-01-01' as timestamp) as captured_at", "cast(null as string) as sha256", "case when id % 1000 = 0 then '00000000000000ff' else '000000000000000f' end as phash", "false as missing", "'local' as source")
    members, links = neardup.near_duplicate_classes(rows, hot=1)
    assert members.count() == 60_000 and sorted((r.a_bits, r.b_bits, r.hamming_distance) for r in links.collect()) == [(15, 15, 0), (15, 255, 4), (255, 255, 0)]


def test_no_part_of_the_hash_lies_in_one_half():
    """Hashes that share half of their bits, as neighbouring ones, must not meet all in one part."""
    masks = neardup._masks(neardup.MAX_HAMMING)
    assert sum(masks) == (1 << 64) - 1 and len(masks) == 5
    for half in ((1 << 32) - 1, ((1 << 32) - 1) << 32, 0x00FF00FF00FF00FF):
        assert all((m & half).bit_count() >= 6 for m in masks)


@pytest.mark.parametrize("most", [0, 1, 5, 8, 11])
def test_crowds_at_other_distances(spark, most):
    p = photos(spark, *_burst(150, 2))
    want = sorted(tuple(r) for r in neardup.near_duplicates(p, max_hamming=most).collect())
    assert sorted(tuple(r) for r in neardup.pairs_of_classes(*neardup.near_duplicate_classes(p, hot=0, max_hamming=most)).collect()) == want


def test_bursts_are_compared_class_by_class(spark):
    """400 photos of two classes: three comparisons of classes stand for all pairs, of which none is made twice and taken out again."""
    rows = spark.range(400).selectExpr("id", "cast('2024-01-01' as timestamp) as captured_at", "cast(id as string) as sha256", "case when id % 2 = 0 then '00000000000000ff' else '000000000000000f' end as phash", "false as missing", "'local' as source")
    found = neardup.near_duplicates_banded(rows)
    assert "photo_a" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate" in x)
    assert sorted((r.photo_a, r.photo_b) for r in found.collect()) == [(a, b) for a in range(400) for b in range(a + 1, 400)]


@pytest.mark.parametrize(("hot", "most", "batch"), [(0, 8, 7), (0, 8, 10_000), (40, 5, 50), (0, 0, 50), (0, 64, 50), (10**9, 8, 50)])
def test_dealt_blocks_have_exact_pairs(spark, monkeypatch, hot, most, batch):
    """Blocks of 9 to 40 photos, of buckets of one and several, before and behind crowds."""
    monkeypatch.setattr(neardup, "LEAST_BLOCK", 9)
    monkeypatch.setattr(neardup, "MOST_BLOCK", 40)
    monkeypatch.setattr(neardup, "BLOCKS", 4)
    p = photos(spark, *_burst(260, 3), photo(9002, phash="f" * 16, captured_at=None)).repartition(5)
    want = sorted(tuple(r) for r in neardup.near_duplicates(p, max_hamming=most).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = neardup.near_duplicates_dealt(p, max_hamming=most, hot=hot)
        assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 30
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found.schema.simpleString() == neardup.near_duplicates(p).schema.simpleString()


def test_slabs_of_a_unit_meet_once(monkeypatch):
    """Several slabs and steps of a unit, blocks across batches, pairs handed on in parts; copies of one content aren't pairs, photos without any are."""
    for name, size in (("SLAB", 5), ("STEP", 20), ("HANDED", 10)):
        monkeypatch.setattr(neardup, name, size)
    r = random.Random(4)
    rows = sorted(((0, b, one, two, s, bits, sha, i) for b, one, two, s in [(False, 0, 0, False), (False, 0, 1, False), (False, 0, 1, True), (True, 0, 0, False), (True, 0, 0, True)] for i in range(s * 100, s * 100 + 23) for bits in [r.choice([0, 3, 1 << 63, (1 << 20) - 1])] for sha in [r.choice(["", "x", "x", "y"])]), key=lambda x: x[:7])
    cols = ["bucket", "before", "one", "two", "second", "bits", "sha256", "id"]
    table = pa.table({c: [x[k] - (1 << 64) if c == "bits" and x[k] >> 63 else x[k] or (None if c == "sha256" else x[k]) for x in rows] for k, c in enumerate(cols)} | {"us": [x[7] % 4 for x in rows]})
    got = sorted(tuple(x.values()) for b in neardup._near_in_blocks(2, 8)(table.to_batches(max_chunksize=17)) for x in b.to_pylist())
    want = []
    for k, a in enumerate(rows):
        for b in rows[k + 1 :]:
            meet = a[:4] == b[:4] and (a[4] != b[4] or (not a[1] and a[2] == a[3]))
            if meet and not (a[6] and a[6] == b[6]) and abs(a[7] % 4 - b[7] % 4) <= 2 and (d := (a[5] ^ b[5]).bit_count()) <= 8:
                want.append((min(a[7], b[7]), max(a[7], b[7]), d))
    assert got == sorted(want) and len(got) > 100


def _shuffled(spark, df):
    """Rows that df's stages write for others, with joins that broadcast nothing by themselves."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: [x for x in _seq(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))]
    _seq = lambda s: [s.apply(k) for k in range(s.size())]
    last = max((x.stageId() for x in stages()), default=-1)
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(x.shuffleWriteRecords() for x in stages() if x.stageId() > last)


@pytest.fixture
def no_broadcast(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n in names:
        spark.conf.unset(n)


def test_a_wrong_dates_pairs_are_not_dealt_out(spark, tmp_path, no_broadcast):
    """6000 photos of which a third bear one date: what is shuffled goes with the photos, not with their pairs or the neighbours of their hashes."""
    events = spark.range(6000).selectExpr("id as event_id", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 20) as ts", "id % 50 as user_id", "'view' as event_type", "double(id) as value", "'{\"k\": 4}' as props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = queries.QUERIES["near_duplicates_crowded"](spark, str(tmp_path))
    assert found.count() > 4000
    assert _shuffled(spark, found) < 8 * 6000


def test_a_bursts_pairs_are_not_dealt_out(spark, no_broadcast):
    """1000 photos within five seconds, their hashes near each other: 499,500 pairs, and a few rows shuffled for each photo."""
    rows = spark.range(1000).selectExpr("id", "timestamp_millis(1700000000000 + id * 5) as captured_at", "cast(id as string) as sha256", "lpad(hex(id % 256), 16, '0') as phash", "false as missing", "'local' as source")
    found = neardup.near_duplicates_banded(rows)
    assert found.count() == 499_500
    assert _shuffled(spark, found) < 8 * 1000


def test_disconnecting_takes_previews_along(spark):
    p = photos(spark, photo(1, source="icloud", account="A@x.org", remote_id="r1"), photo(2, source="icloud", account="b", remote_id="r2"), photo(3, account="A@x.org"))
    names = ["icloud-a-x-org-r1.jpg", "icloud-a-x-org-r1-medium.jpg", "icloud-a-x-org-gone.jpg", "icloud-b-r2.jpg", "icloud-a-x-org-r1.tmp", "abc.jpg"]
    previews = spark.createDataFrame([(n, 1) for n in names], "name string, size long")
    kept, gone, report = remote.disconnect_plan(p, previews, "A@x.org")
    assert sorted(r.id for r in kept.collect()) == [2, 3] and sorted(r.name for r in gone.collect()) == sorted(names[:3])
    assert [tuple(r) for r in report.collect()] == [("A@x.org", 1, 3)]
    assert [tuple(r) for r in remote.disconnect_plan(p, previews, "nobody")[2].collect()] == [("nobody", 0, 0)]
    with pytest.raises(ValueError, match="being pulled"):
        remote.disconnect_plan(p, previews, "b", running=["b"])


def test_a_job_counts_on_its_way(spark, tmp_path):
    rows, seen = audit.observed(spark.range(10).withColumn("x", F.col("id") % 4), F.when(F.col("x") == 0, "nought"), "step")
    rows.write.parquet(str(tmp_path / "out"))
    assert [tuple(r) for r in audit.observed_report(spark, {"step": seen}).collect()] == [("step", 7, 3, 10)]
    assert spark.read.parquet(str(tmp_path / "out")).filter("error is not null").count() == 3


def test_preview_keys(spark):
    rows = spark.createDataFrame([("s", "c"), (None, "c"), (None, None)], "sha256 string, content_key string")
    assert [r[0] for r in rows.select(hashing.preview_key()).collect()] == ["s", "c", None]
    assert hashing.hash_large_files(spark.createDataFrame([("/nowhere/x",)], "abs_path string")).collect()[0].error == "FileNotFoundError"
