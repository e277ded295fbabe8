"""The stored timeline against the plain one."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from photolake.operators import stored, timeline
from tests.test_catalog import T0, photo, photos


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [photo(i, captured_at=None if i % 50 == 0 else T0 + timedelta(minutes=(i * 37) % 9000), sha256="abc"[i % 3] if i % 4 == 0 else None, status="rejected" if i % 8 == 0 else "optional", missing=i % 9 == 0, live_photo_video_path=f"p/IMG_{i + 1}.jpg" if i % 11 == 0 else None) for i in range(1, 700)]
    rows += [photo(i, captured_at=T0 - timedelta(days=i % 3), source="icloud", account="kl"[i % 2], remote_id=f"r{i}") for i in range(1000, 1100)]
    return photos(spark, *rows)


@pytest.fixture(scope="module", params=[7, stored.SLICE])
def order(spark, catalog, tmp_path_factory, request):
    old, stored.SLICE = stored.SLICE, request.param
    yield stored.Stored(spark, stored.store_timeline(catalog, str(tmp_path_factory.mktemp("timeline") / "v")))
    stored.SLICE = old


def test_pages_are_the_plain_ones(order, catalog):
    rows = timeline.with_badges(timeline.timeline(catalog), catalog).orderBy(F.asc_nulls_first("captured_at"), "id").collect()
    want = [(r.id, r.dupe_count, r.is_live, r.download_pending) for r in rows]
    assert order.total == len(want) > 450
    pages = -(-len(want) // 90)
    for number, k in [*((n, n) for n in range(1, pages + 1)), ("x", 1), (None, 1), (0, pages), (-3, pages), (10**9, pages)]:
        got = [(r.id, r.dupe_count, r.is_live, r.download_pending) for r in order.page(number, 90).collect()]
        assert got == want[(k - 1) * 90 : k * 90]


def test_neighbours(order, catalog):
    ids = [r.id for r in timeline.timeline(catalog).orderBy(F.asc_nulls_first("captured_at"), "id").select("id").collect()]
    when = {r.id: r.captured_at for r in catalog.select("id", "captured_at").collect()}
    for at in (0, 5, len(ids) // 2, len(ids) - 1):
        got = order.around(ids[at], when[ids[at]], 3).collect()
        assert [(r.pos, r.id) for r in got] == [(k, ids[k]) for k in range(max(at - 3, 0), min(at + 4, len(ids)))]
    hidden = next(i for i in when if i not in ids)
    assert order.around(hidden, when[hidden]).count() == 0 and order.around(1, T0 - timedelta(days=9999)).count() == 0


def test_a_page_sorts_and_reads_little(order):
    plan = order.page(3, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "Window" not in plan
    assert order.page(3, 20).select(F.input_file_name()).distinct().count() <= 1 + 20 // min(stored.SLICE, 20) + 2


def test_ranks(spark, order, catalog):
    probes = spark.createDataFrame([(a, T0 - timedelta(days=d, seconds=s)) for a in ("k", "l", "none") for d in (0, 1, 5) for s in (0, 1)], "account string, at timestamp")
    got = {(r.account, r.at): r["rank"] for r in order.date_rank(probes).collect()}
    rows = [(r.account, r.captured_at) for r in catalog.filter("source = 'icloud'").collect()]
    assert got == {(r.account, r.at): sum(a == r.account and t > r.at for a, t in rows) for r in probes.collect()}


def test_empty(spark, tmp_path):
    empty = stored.Stored(spark, stored.store_timeline(photos(spark), str(tmp_path / "v")))
    assert empty.total == 0 and empty.page(1).count() == 0 and empty.page(5).count() == 0
