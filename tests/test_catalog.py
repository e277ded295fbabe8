"""Catalog operators on hand-made rows."""

from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from photolake import schemas
from photolake.functions import dates, hashing, paths
from photolake.operators import audit, decisions, dedup, live, neardup, scan, timeline
from photolake.plans import moves
from photolake.sources import listing, remote, state

T0 = datetime(2025, 6, 14, 18, 30, 12)


def photo(i, **kw):
    base = dict(
        id=i, relative_path=f"p/IMG_{i}.jpg", status="optional", original_path="", provenance="", file_size=1234, file_mtime=1700000000.0, sha256=None, phash=None, captured_at=T0, captured_at_source="exif",
        media_type="image", live_photo_video_path=None, missing=False, status_changed_at=None, indexed_at=None, source="local", account="", remote_id=None, remote_filename="", source_ref=None,
    )
    return tuple((base | kw).values())


def photos(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.PHOTOS)


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize("path,status,prov", [("selected/a/x.jpg", "selected", "a"), ("selected/x.jpg", "selected", ""), ("rejected/b/c/x.jpg", "rejected", "b"), ("a/x.jpg", "optional", "a"), ("x.jpg", "optional", ""), ("selected", "selected", "")])
def test_status_and_provenance(spark, path, status, prov):
    assert one(spark, paths.status_of("p"), p=path) == status
    assert one(spark, paths.provenance_of("p"), p=path) == prov


@pytest.mark.parametrize("n,text", [(0, "0 bytes"), (500, "500 bytes"), (2048, "2.00 KB"), (5 << 20, "5.00 MB"), (3 << 30, "3.00 GB")])
def test_human_size(spark, n, text):
    assert one(spark, paths.human_size("n"), n=n) == text


def test_paths(spark):
    assert one(spark, paths.account_slug("a"), a=" Luis@Example.com ") == "luis-example-com"
    assert one(spark, paths.account_slug("a"), a="") == "account"
    assert one(spark, paths.rel_from_sentinel("p"), p="@src/7/a/b.jpg") == "a/b.jpg"
    assert one(spark, paths.rel_from_sentinel("p"), p="nothing") == ""
    rows = spark.createDataFrame([("_DSC1.jpg",), (".hidden/x.jpg",), (".x.jpg",), ("a/X.HEIC",), ("y.MOV",), ("n.txt",)], "relative_path string")
    assert {r[0] for r in paths.filter_media(rows).collect()} == {"_DSC1.jpg", "a/X.HEIC", "y.MOV"}


@pytest.mark.parametrize("name", ["IMG_20250614_183012.jpg", "20250614_183012.jpg", "2025-06-14 18.30.12.jpg", "2025-06-14_18-30-12.jpg", "PXL_20250614_183012.MP.jpg"])
def test_filename_dates(spark, name):
    assert one(spark, dates.filename_ts(F.col("n")), n=name) == T0


@pytest.mark.parametrize("name", ["IMG_20251314_183012.jpg", "IMG_20250614_183060.jpg", "IMG_18250614_183012.jpg", "plain.jpg"])
def test_filename_without_date(spark, name):
    assert one(spark, dates.filename_ts(F.col("n")), n=name) is None


def test_capture_chain(spark):
    rows = [("a.jpg", 0.0, "2025:06:14 18:30:12", None, None, None, None), ("IMG_20250614_183012.jpg", 0.0, None, None, "junk", "2025:01:01 00:00:00", None), ("b.jpg", 1700000000.0, "junk", "2025:01:01 00:00:00", "", None, None)]
    df = spark.createDataFrame(rows, "relative_path string, file_mtime double, exif_datetime_original string, exif_datetime string, raw_dto string, raw_cd string, raw_mcd string")
    got = [(r.captured_at, r.captured_at_source) for r in dates.capture_date(df).collect()]
    assert got == [(T0, "exif"), (T0, "filename"), (datetime(2023, 11, 14, 22, 13, 20), "file_mtime")]


def test_duplicates_and_timeline(spark):
    p = photos(spark, photo(1, sha256="b", status="rejected"), photo(2, sha256="b"), photo(3, sha256="c", status="rejected"), photo(4, sha256="c", status="rejected"), photo(5, sha256="b", missing=True), photo(6), photo(7, relative_path="p/IMG_6.mov"), photo(8, live_photo_video_path="p/IMG_6.mov"))
    assert {(r.sha256, r.n) for r in dedup.duplicate_counts(p).collect()} == {("b", 2), ("c", 2)}
    assert {r.id for r in dedup.redundant_copies(p).collect()} == {1, 4} == {r.id for r in dedup.redundant_copies_by_rank(p).collect()}
    shown = timeline.timeline(p)
    assert {r.id for r in shown.collect()} == {2, 3, 6, 8}
    assert {r.id for r in timeline.timeline(p, status="rejected").collect()} == {3}
    n = {r.id: (r.prev_id, r.next_id, r["index"], r.total) for r in timeline.neighbours(shown).collect()}
    assert n == {2: (None, 3, 0, 4), 3: (2, 6, 1, 4), 6: (3, 8, 2, 4), 8: (6, None, 3, 4)}
    assert {r.id: r.ids for r in timeline.filmstrip(shown, 1).collect()} == {2: [2, 3], 3: [2, 3, 6], 6: [3, 6, 8], 8: [6, 8]}
    assert [r.id for r in timeline.page(shown, "x", 3).collect()] == [2, 3, 6] and [r.id for r in timeline.page(shown, 99, 3).collect()] == [8]


def test_near_duplicates_bounds(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    p = photos(spark, photo(9, phash="0" * 16), photo(2, phash="0" * 14 + "ff", captured_at=at(8)), photo(3, phash="0" * 16, captured_at=at(8.000001)), photo(4, phash="0" * 13 + "1ff", captured_at=at(1)), photo(5, phash="zz", captured_at=at(1)), photo(6, phash="0" * 16, captured_at=at(1), source="icloud"))
    want = {(2, 9, 8), (2, 3, 8), (2, 4, 1), (3, 4, 9)}
    got = {tuple(r) for r in neardup.near_duplicates(p).collect()}
    assert got == {x for x in want if x[2] <= 8} == {tuple(r) for r in neardup.near_duplicates_banded(p).collect()}
    assert [r.id for r in neardup.split_bad_phash(p)[1].collect()] == [5]
    pairs = spark.createDataFrame([(2, 9, 8, True)], schemas.PAIRS)
    merged = neardup.merge_pairs(pairs, neardup.near_duplicates(p))
    assert {(r.photo_a, r.photo_b, r.resolved) for r in merged.collect()} == {(2, 9, True), (2, 3, False), (2, 4, False)}
    assert neardup.merge_pairs(merged, neardup.near_duplicates(p)).count() == 3


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 40_000_000), st.integers(0, 3)), max_size=25))
def test_near_duplicates_model(spark, rows):
    hashes = ["0" * 16, "0" * 15 + "f", "f" * 16, "f" * 15 + "0"]
    p = photos(spark, *(photo(i, phash=hashes[h], captured_at=T0 + timedelta(microseconds=us)) for i, (us, h) in enumerate(rows)))
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if abs(rows[i][0] - rows[j][0]) <= 8_000_000 and rows[i][1] // 2 == rows[j][1] // 2}
    assert {(r.photo_a, r.photo_b) for r in neardup.near_duplicates(p).collect()} == want


def test_live_pairs(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    p = photos(spark, photo(1, relative_path="a/IMG.jpg"), photo(2, relative_path="a/img.MOV", captured_at=at(1), media_type="video"), photo(3, relative_path="b/X.jpg"), photo(4, relative_path="b/X.mov", captured_at=at(0.5), media_type="video"), photo(5, relative_path="b/x.mov", captured_at=at(2), media_type="video"), photo(6, relative_path="c/IMG.jpg", live_photo_video_path="gone.mov"))
    out = {r.id: r.live_photo_video_path for r in live.pair_live_photos(p).collect()}
    assert out[1] == "a/img.MOV" and out[3] is None and out[6] is None


def test_scan_and_moves(spark):
    p = photos(spark, photo(1, relative_path="a/x.jpg", sha256="s1"), photo(2, relative_path="a/y.jpg"), photo(3, relative_path="a/z.jpg", missing=True))
    rows = [("a/new/x.jpg", 1234, 1700000000.0, T0, "exif"), ("a/y.jpg", 1234, 1700000100.0, T0, "exif"), ("a/z.jpg", 1234, 1700000000.0, T0, "exif")]
    new = spark.createDataFrame(rows, "relative_path string, file_size long, file_mtime double, captured_at timestamp, captured_at_source string")
    diff = scan.diff_listing(p, new)
    assert {r.relative_path: r.kind for r in diff.collect()} == {"a/x.jpg": "vanished", "a/new/x.jpg": "new", "a/y.jpg": "changed", "a/z.jpg": "changed"}
    after = scan.apply_listing(p, new)
    assert {r.relative_path: r.id for r in after.collect()}["a/new/x.jpg"] == 4
    gone = p.filter("id = 1").withColumn("root_id", F.lit(None).cast("long"))
    fresh = spark.createDataFrame([(None, "a/new/x.jpg", 1234, 1700000000.0, "s1")], "root_id long, relative_path string, file_size long, file_mtime double, sha256 string")
    moved = scan.reconcile_moves(gone, fresh)
    linked = {r.id: (r.relative_path, r.sha256) for r in scan.relink(after, moved).collect()}
    assert linked[1] == ("a/new/x.jpg", "s1") and 4 not in linked
    again = scan.apply_listing(scan.relink(after, moved), new)
    assert {r.kind for r in scan.diff_listing(again, new).collect()} == {"unchanged"}


@pytest.mark.parametrize("gone,new,want", [
    ([(1, None), (2, None)], [("b", "h")], {1: "b"}), ([(1, "h")], [("b", "h"), ("c", "k")], {1: "b"}), ([(1, "q")], [("b", "h")], {}), ([(1, None)], [("b", "h"), ("c", "k")], {}), ([(1, "h"), (2, None)], [("b", "h"), ("c", "k")], {1: "b", 2: "c"}),
])
def test_reconcile(spark, gone, new, want):
    v = spark.createDataFrame([(1, i, T0 + timedelta(seconds=i), 5, 1.0, h) for i, h in gone], "root_id long, id long, captured_at timestamp, file_size long, file_mtime double, sha256 string")
    n = spark.createDataFrame([(1, p, 5, 1.0, h) for p, h in new], "root_id long, relative_path string, file_size long, file_mtime double, sha256 string")
    assert {r.id: r.new_path for r in scan.reconcile_moves(v, n).collect()} == want


def _replay(start, acts):
    status = {i: s for i, (s, _) in start.items()}
    for photo_id, new in acts:
        status[photo_id] = new
        for i, (_, sha) in start.items():
            if i != photo_id and sha and sha == start[photo_id][1]:
                status[i] = "rejected"
    return status


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.sampled_from(schemas.STATUSES)), max_size=12), st.lists(st.sampled_from(["a", "b", None]), min_size=7, max_size=7))
def test_group_cull_is_a_fold(spark, acts, shas):
    p = photos(spark, *(photo(i, sha256=s) for i, s in enumerate(shas)))
    a = spark.createDataFrame([(n, T0 + timedelta(seconds=n), i, s) for n, (i, s) in enumerate(acts)], schemas.ACTIONS)
    assert {r.id: r.status for r in decisions.fold_actions(p, a).collect()} == _replay({i: ("optional", s) for i, s in enumerate(shas)}, acts)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["d/a.jpg", "d/a (1).jpg", "d/b.jpg", "a", "d/a (1) (2).jpg"]), max_size=10), st.sets(st.sampled_from(["d/a.jpg", "d/a (2).jpg", "a"])))
def test_unique_names(spark, asked, there):
    taken, want = set(there), []
    for path in asked:
        base, dot = (path[:-4], ".jpg") if path.endswith(".jpg") else (path, "")
        n, name = 0, path
        while name in taken:
            n += 1
            name = f"{base} ({n}){dot}"
        taken.add(name)
        want.append(name)
    plan = spark.createDataFrame([(i + (1 << 60), i, p) for i, p in enumerate(asked)], "key long, ord long, path string")
    got = {r.key - (1 << 60): r.final_path for r in moves.assign_unique(plan, spark.createDataFrame([(x,) for x in there], "path string")).collect()}
    assert [got[i] for i in range(len(asked))] == want


def test_move_plan_takes_the_clip_along(spark):
    p = photos(spark, photo(1, relative_path="a/IMG.jpg", live_photo_video_path="a/IMG.mov"), photo(2, relative_path="a/IMG.mov", media_type="video"))
    there = spark.createDataFrame([("a/IMG.jpg",), ("a/IMG.mov",), ("selected/IMG.jpg",)], "path string")
    plan = moves.plan_moves(p, spark.createDataFrame([(1, "selected")], "id long, new_status string"), there)
    assert {(r.role, r.from_path, r.to_path) for r in plan.collect()} == {("image", "a/IMG.jpg", "selected/IMG (1).jpg"), ("companion", "a/IMG.mov", "selected/IMG.mov")}
    after = {r.id: (r.relative_path, r.status, r.original_path, r.live_photo_video_path) for r in moves.apply_moves(p, plan).collect()}
    assert after[1] == ("selected/IMG (1).jpg", "selected", "a/IMG.jpg", "selected/IMG.mov") and after[2][:2] == ("selected/IMG.mov", "selected")


def test_export_refuses_the_library():
    moves.refuse_inside("/out", "/lib")
    with pytest.raises(ValueError):
        moves.refuse_inside("/lib/out", "/lib")


def test_pull_is_idempotent(spark):
    rows = [("l@x.org", 0, "r1", "a.HEIC", T0, 1000, "image", False), ("l@x.org", 1, "r2", None, T0, None, "movie", False), ("l@x.org", 2, "r1", "b.HEIC", T0, 5, "image", False), ("l@x.org", 3, "r3", "c.jpg", T0, 1, "image", False)]
    got = remote.read_remote_listing(spark.createDataFrame(rows, schemas.REMOTE_LISTING))
    down = spark.createDataFrame([("l@x.org", "r3")], "account string, remote_id string")
    named = spark.createDataFrame([("l@x.org", "r2", "rejected")], "account string, remote_id string, status string")
    first = remote.pull(photos(spark), got, down, named)
    assert {(r.relative_path, r.status, r.file_size, r.media_type) for r in first.collect()} == {("@icloud/l@x.org/r1", "optional", 1000, "image"), ("@icloud/l@x.org/r2", "rejected", 0, "video")}
    assert remote.pull(first, got, down, named).count() == 2
    rest, removed = remote.disconnect(first, "l@x.org")
    assert rest.count() == 0 and removed.first()[0] == 2


def test_state_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"account": "l@x.org", "cursor": "2025-06-14T10:00:00+00:00", "decisions": {"r1": "rejected"}, "downloaded": {"r2": "selected/r2.jpg"}, "version": 1}')
    (tmp_path / "b.json").write_text("{broken")
    states, named, got, bad = state.read_account_states(spark, str(tmp_path))
    assert states.first() == ("l@x.org", datetime(2025, 6, 14, 10)) and named.first() == ("l@x.org", "r1", "rejected") and bad.count() == 1
    out = state.write_account_states(state.account_documents(states, named, got), str(tmp_path / "out"))
    assert state.read_account_states(spark, out)[2].first() == ("l@x.org", "r2", "selected/r2.jpg")


def test_states_read_back_whole(spark, tmp_path):
    accounts = [(f"a{i}@x.org", None if i == 2 else T0) for i in range(5)]
    states = spark.createDataFrame(accounts, "account string, cursor timestamp")
    named = spark.createDataFrame([(f"a{i}@x.org", f"r{k}", "optional" if k == 0 else "rejected") for i in range(4) for k in range(3)], "account string, remote_id string, status string")
    got = spark.createDataFrame([("a0@x.org", "r9", 'selected/}\n{".jpg')], "account string, remote_id string, relative_path string")
    state.write_account_states(state.account_documents(states, named, got).coalesce(1), str(tmp_path / "out"))
    out = Path(state.current(spark, str(tmp_path / "out")))
    (out / "broken.json").write_text("{broken")
    (out / "list.json").write_text("[1, 2]")
    (out / "nested.json").write_text('{"account": "n@x.org",\n "decisions": {\n "r1": "rejected", "n": 5\n }\n}')
    a, b, c, bad = state.read_account_states(spark, str(tmp_path / "out"))
    assert {r.account: r.cursor for r in a.collect()} == dict(accounts) | {"n@x.org": None}
    assert {tuple(r) for r in b.collect()} == {tuple(r) for r in named.filter("status <> 'optional'").collect()} | {("n@x.org", "r1", "rejected"), ("n@x.org", "n", "5")}
    assert c.collect() == got.collect() and {r._corrupt for r in bad.collect()} == {"{broken", "[1, 2]"}
    assert state.read_account_states(spark, str(tmp_path / "none"))[0].count() == 0
    sources = spark.createDataFrame([(1, "disk"), (2, "card")], "id long, name string")
    marks = spark.createDataFrame([(1, "a.jpg", "rejected"), (1, "b.jpg", "optional"), (2, "c.jpg", "selected")], "source_id long, relative_path string, status string")
    state.write_states(state.source_documents(sources, marks), str(tmp_path / "src"))
    (Path(state.current(spark, str(tmp_path / "src"))) / "disk.json").write_text('{"decisions": {"d.jpg": "rejected"}}')
    back, bad = state.read_source_states(spark, str(tmp_path / "src"), sources)
    assert {tuple(r) for r in back.collect()} == {(1, "a.jpg", "rejected"), (2, "c.jpg", "selected"), (1, "d.jpg", "rejected")} and bad.count() == 0


def test_listing_walk(spark, tmp_path):
    for name in ("_DSC1.jpg", "a/b/x.HEIC", ".h/x.jpg", "a/.x.jpg", "n.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    rows = listing.list_media(spark, spark.createDataFrame([(1, str(tmp_path))], "root_id long, path string")).collect()
    assert {r.relative_path for r in rows} == {"_DSC1.jpg", "a/b/x.HEIC"}


def test_phash(spark):
    rng = np.random.default_rng(0)
    image = rng.normal(0, 20, (32, 32)).cumsum(axis=0).cumsum(axis=1).ravel()
    rows = spark.createDataFrame([(image.tolist(),), ((image * 1.1 + 3).tolist(),), ([1.0],)], "g array<double>")
    a, b, c = (r[0] for r in rows.select(hashing.phash64(F.col("g"))).collect())
    assert len(a) == 16 and bin(int(a, 16) ^ int(b, 16)).count("1") <= 2 and c is None


def test_audit_and_empty_tables(spark):
    p = photos(spark)
    assert {r.status: r.n for r in audit.counts_by_status(p).collect()} == {"optional": 0, "selected": 0, "rejected": 0}
    assert audit.selected_bytes(p).first()[0] == 0 and timeline.neighbours(timeline.timeline(p)).count() == 0
    assert neardup.near_duplicates(p).count() == 0 and schemas.check_invariants(p).count() == 0


def test_hashes_of_long_documents(spark, tmp_path):
    import hashlib

    import duckdb

    import __spark_entry__ as e

    texts = {1: "", 2: "short é", 3: "x" * 65536, 4: "x" * 65535 + "é tail", 5: "x" * 65535 + "é other tail", 6: "日本 " * 50_000}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = e.queries()["content_hashes_whole"](spark, str(tmp_path)).select("doc_id", "sha256", "content_key")
    got = {r.doc_id: (r.sha256, r.content_key) for r in df.collect()}
    raw = {i: t.encode() for i, t in texts.items()}
    assert got == {i: (hashlib.sha256(b).hexdigest(), hashlib.sha1(b[:65536] + str(len(texts[i])).encode()).hexdigest()) for i, b in raw.items()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert {a: (b, c) for a, b, c in con.execute(f"select doc_id, sha256, content_key from ({e.oracle_sql()['content_hashes_whole']})").fetchall()} == got


def _greedy(gone, free):
    """The rule told row by row: (id, hash) in order, {path: hash}."""
    left, out = dict(sorted(free.items())), {}
    for i, h in gone:
        own = [p for p, q in left.items() if q == h] if h else list(left) if len(left) == 1 else []
        if own:
            out[i] = own[0]
            del left[own[0]]
    return out


def test_reconcile_equals_the_rule_row_by_row(spark):
    import random

    r = random.Random(11)
    gone, new, want = [], [], {}
    for g in range(150):
        own = [(g * 100 + k, r.choice(["h", "k", "q", None, ""])) for k in range(r.randrange(0, 7))]
        free = {f"p{k}": r.choice(["h", "k", None]) for k in range(r.randrange(0, 6))}
        root = None if g % 2 else g
        gone += [(root, i, T0 + timedelta(seconds=i // 2), g, 1.0, h) for i, h in own]
        new += [(root, p, g, 1.0, h) for p, h in free.items()]
        want |= _greedy(own, free)
    v = spark.createDataFrame(gone, "root_id long, id long, captured_at timestamp, file_size long, file_mtime double, sha256 string")
    n = spark.createDataFrame(new, "root_id long, relative_path string, file_size long, file_mtime double, sha256 string")
    got = scan.reconcile_moves(v, n).collect()
    assert len(got) == len(want) and {x.id: x.new_path for x in got} == want


def test_ranks_of_a_group_over_many_partitions(spark):
    from photolake.operators.ranks import rank_within

    rows = spark.range(5000).select((F.col("id") % 7 / 6).cast("int").alias("g"), ((F.col("id") * 37) % 5003).alias("v"))
    got = {(x.g, x.v): x.n for x in rank_within(rows, ["g"], ["v"], "n").collect()}
    for g in (0, 1):
        assert [got[g, v] for v in sorted(v for h, v in got if h == g)] == list(range(sum(h == g for h, _ in got)))
