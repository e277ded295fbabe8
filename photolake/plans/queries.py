"""The catalog's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.functions import dates, hashing, paths
from photolake.operators import audit, decisions, dedup, live, neardup, scan, timeline
from photolake.operators.joins import left_join_sparse
from photolake.plans import moves, views
from photolake.plans.views import ACTIONS_SQL, FILES_SQL, PAIRS_SQL, PHOTOS_SQL, REMOTE_SQL
from photolake.session import table, work_dir
from photolake.sources import remote, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(ctes: str | None = None, sql: str = ""):
    """Adds a query under its function's name, with its SQL where SQL says it shortly."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"with {ctes} done as (select 1) {sql}" if ctes else sql
        return f

    return add


us = lambda c: F.unix_micros(c)
SHOWN = ("id", "status", "provenance")
ROW = "id, epoch_us(captured_at) as captured_us, status, provenance"


def _rows(df: DataFrame) -> DataFrame:
    return df.select("id", us("captured_at").alias("captured_us"), "status", "provenance")


@register(PHOTOS_SQL, f"select {ROW}, coalesce(r.n, 0) as dupe_count, coalesce(live_photo_video_path, '') <> '' as is_live, source = 'icloud' and status = 'selected' as download_pending from shown left join (select sha256, n from reps where n > 1) r using (sha256) order by captured_at, id limit 200")
def timeline_first_page(s, d):
    """T4, T9 from the stored order, which is written first where this session hasn't yet."""
    out = views.stored(s, d).page(1)
    return out.select("id", us("captured_at").alias("captured_us"), "status", "provenance", "dupe_count", "is_live", "download_pending")


@register(PHOTOS_SQL, "select cast(captured_at as date) as day, count(*) as n, cast(sum(count(*)) over (order by cast(captured_at as date)) - count(*) as bigint) as before from shown group by 1")
def timeline_stored(s, d):
    """The stored order written anew: its days with their running sums."""
    return s.read.parquet(f"{views.stored(s, d, fresh=True).base}/days").select(F.to_date("day").alias("day"), "n", "before")


@register(PHOTOS_SQL, "select s.id, s.pos - 30 as away from (select id, row_number() over (order by captured_at, id) - 1 as pos from shown) s where s.pos between 20 and 40")
def timeline_around(s, d):
    """T6, T7 of the photo at place 30."""
    stored = views.stored(s, d)
    own = stored.between(30, 31).first()
    return stored.around(own.id, own.captured_at).select("id", (F.col("pos") - 30).alias("away"))


@register(PHOTOS_SQL, "select account, (select count(*) from photos q where q.source = 'icloud' and q.account = a.account and q.captured_at > timestamp '2024-01-10 12:00:00') as rank from (select distinct account from photos where source = 'icloud') a")
def date_rank_stored(s, d):
    """T12 of one time in each account."""
    probes = views.photos(s, d).filter("source = 'icloud'").select("account", F.lit("2024-01-10 12:00:00").cast("timestamp").alias("at")).distinct()
    return views.stored(s, d).date_rank(probes).select("account", "rank")


@register(PHOTOS_SQL, f"select {ROW} from shown where status = 'optional' and provenance = 'acct-1' and captured_at >= timestamp '2024-01-03' and captured_at < timestamp '2024-01-21' and captured_at_source <> 'exif'")
def timeline_filtered(s, d):
    return _rows(timeline.timeline(views.photos(s, d), "optional", "acct-1", "2024-01-03", "2024-01-20", low_confidence_only=True))


@register(PHOTOS_SQL, f"select {ROW} from photos where missing")
def timeline_missing(s, d):
    return _rows(timeline.timeline(views.photos(s, d), show_missing=True))


@register(PHOTOS_SQL + PAIRS_SQL, f"select {ROW} from shown where media_type = 'image' and id in (select photo_a from pairs where not resolved union all select photo_b from pairs where not resolved)")
def timeline_unresolved_images(s, d):
    return _rows(timeline.timeline(views.photos(s, d), media_type="image", unresolved_in=views.pairs(s, d)))


@register(PHOTOS_SQL, f"select {ROW} from shown order by captured_at, id limit 200 offset 400")
def timeline_third_page(s, d):
    return _rows(timeline.page(timeline.timeline(views.photos(s, d)), 3))


@register(PHOTOS_SQL, f"select {ROW} from (select *, row_number() over (order by captured_at, id) - 1 as pos, (select count(*) from shown) as total from shown) where pos >= (total - 1) // 200 * 200")
def timeline_last_page(s, d):
    return _rows(views.stored(s, d).page(10**9))


@register(PHOTOS_SQL, f"select {ROW} from (select *, row_number() over (order by captured_at, id) - 1 as pos, (select count(*) from shown) as total from shown) where pos >= (total - 1) // 200 * 200")
def timeline_last_page_ranked(s, d):
    """T4 without a stored order."""
    return _rows(timeline.page(timeline.timeline(views.photos(s, d)), 10**9))


@register(PHOTOS_SQL, f"select {ROW} from shown where captured_at > timestamp '2024-01-10' order by captured_at, id limit 200")
def timeline_keyset_page(s, d):
    return _rows(timeline.page_after(timeline.timeline(views.photos(s, d)), "2024-01-10", 1 << 62))


@register(PHOTOS_SQL, "select cast(captured_at as date) as day, strftime(captured_at, '%a %-d %b %Y') as label, count(*) as n from shown group by 1, 2")
def day_groups(s, d):
    return timeline.by_day(timeline.timeline(views.photos(s, d)))


@register(PHOTOS_SQL, "select cast(captured_at as date) as day, strftime(captured_at, '%a %-d %b %Y') as label, string_agg(cast(id as varchar), ',' order by captured_at, id) as ids from (select * from shown order by captured_at, id limit 200) group by 1, 2")
def day_groups_of_page(s, d):
    days = timeline.by_day_items(timeline.page(timeline.timeline(views.photos(s, d)), 1))
    return days.select("day", "label", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@register(PHOTOS_SQL, 'select id, lag(id) over w as prev_id, lead(id) over w as next_id, row_number() over w - 1 as "index", count(*) over () as total from shown window w as (order by captured_at, id)')
def neighbours(s, d):
    return timeline.neighbours(timeline.timeline(views.photos(s, d)))


@register(PHOTOS_SQL, "select id, array_to_string(list(id) over (order by captured_at, id rows between 10 preceding and 10 following), ',') as ids from shown")
def filmstrip(s, d):
    return timeline.filmstrip(timeline.timeline(views.photos(s, d))).select("id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@register(PHOTOS_SQL, "select id, epoch_us(status_changed_at) as changed_us from photos where status_changed_at is not null order by status_changed_at desc, id desc limit 10")
def recent_activity(s, d):
    return timeline.recent_activity(views.photos(s, d)).select("id", us("status_changed_at").alias("changed_us"))


@register(PHOTOS_SQL, "select distinct provenance from photos where provenance <> ''")
def distinct_provenances(s, d):
    return timeline.distinct_provenances(views.photos(s, d))


@register(PHOTOS_SQL, "select account, epoch_us(cap) as at_us, rank, greatest(0, rank - 25) as \"offset\", cast(360 as bigint) as \"limit\" from (select distinct account, captured_at as cap, rank() over (partition by account order by captured_at desc) - 1 as rank from photos where source = 'icloud')")
def date_rank(s, d):
    p = views.photos(s, d)
    probes = p.filter("source = 'icloud'").select("account", F.col("captured_at").alias("at"), F.lit(60).alias("wanted"))
    out = timeline.date_rank(p, probes)
    return out.select("account", us("at").alias("at_us"), F.col("rank").cast("long").alias("rank"), F.col("offset").cast("long").alias("offset"), "limit")


@register(PHOTOS_SQL, "select sha256, n from reps where n > 1")
def duplicate_counts(s, d):
    return dedup.duplicate_counts(views.photos(s, d))


@register(PHOTOS_SQL, "select sha256, keep as id, n from reps")
def representatives(s, d):
    return dedup.representatives(views.photos(s, d))


@register(PHOTOS_SQL, "select id, sha256 from redundant")
def redundant_copies(s, d):
    return dedup.redundant_copies(views.photos(s, d))


@register(PHOTOS_SQL, "select id, sha256 from redundant")
def redundant_copies_by_window(s, d):
    """A4 by ranks."""
    return dedup.redundant_copies_by_rank(views.photos(s, d))


@register(PHOTOS_SQL, "select id, sha256 from hashed where sha256 in (select sha256 from hashed where status = 'selected')")
def duplicate_group(s, d):
    p = views.photos(s, d)
    return dedup.duplicate_group(p, p.filter("status = 'selected'")).select("id", "sha256")


@register(PHOTOS_SQL, "select p as relative_path from companions")
def companion_paths(s, d):
    return timeline.companion_paths(views.photos(s, d))


@register(PHOTOS_SQL, "select status, count(*) as n from photos group by status")
def counts_by_status(s, d):
    return audit.counts_by_status(views.photos(s, d))


@register(PHOTOS_SQL, "select case when provenance = '' then '(root)' else provenance end as provenance, count(*) filter (status = 'optional') as optional, count(*) filter (status = 'selected') as selected, count(*) filter (status = 'rejected') as rejected, count(*) as total from photos group by 1")
def provenance_matrix(s, d):
    return audit.provenance_matrix(views.photos(s, d))


@register(PHOTOS_SQL, "select cast(coalesce(sum(file_size), 0) as bigint) as bytes from photos where status = 'selected'")
def selected_bytes(s, d):
    return audit.selected_bytes(views.photos(s, d))


@register(PHOTOS_SQL, "select count(*) as total, count(*) filter (missing) as missing from photos")
def totals(s, d):
    return audit.totals(views.photos(s, d))


@register(PHOTOS_SQL + PAIRS_SQL, "select * from pairs where not resolved and photo_a in (select id from photos where not missing) and photo_b in (select id from photos where not missing)")
def unresolved_pairs(s, d):
    return audit.unresolved_pairs(views.pairs(s, d), views.photos(s, d))


@register(PHOTOS_SQL + PAIRS_SQL, "select * from pairs where not resolved and photo_a in (select id from photos where not missing) and photo_b in (select id from photos where not missing) and photo_a >= 500 order by photo_a limit 1")
def next_unresolved(s, d):
    return neardup.next_unresolved(views.pairs(s, d), views.photos(s, d), (499, 1 << 40))


_OVERVIEW = "select s.account, (select count(*) from photos p where p.account = s.account) as items, (select count(*) from photos p where p.account = s.account and p.source = 'icloud' and p.status = 'selected' and p.id % 4 <> 0) as pending, epoch_us(s.cursor) as cursor_us from (select account, max(captured_at) as cursor from photos where account <> '' group by account) s"


@register(PHOTOS_SQL, _OVERVIEW)
def account_overview(s, d):
    p = views.photos(s, d)
    states = p.filter("account <> ''").groupBy("account").agg(F.max("captured_at").alias("cursor"))
    got = p.filter("source = 'icloud' and id % 4 = 0").select("account", "remote_id")
    return audit.account_overview(p, states, got).select("account", "items", "pending", us("cursor").alias("cursor_us"))


@register(PHOTOS_SQL, "select 'sizes' as step, count(*) filter (file_size > 1000) as done, count(*) filter (file_size <= 1000) as errors, count(*) as total from photos")
def run_report(s, d):
    p = views.photos(s, d)
    return audit.run_report({"sizes": audit.with_errors(p, F.when(F.col("file_size") <= 1000, "too small"))})


@register(PHOTOS_SQL, "select 'sizes' as step, count(*) filter (file_size > 1000) as done, count(*) filter (file_size <= 1000) as errors, count(*) as total from photos")
def run_report_observed(s, d):
    """A11. Counted by the job itself while it writes its rows."""
    rows, seen = audit.observed(views.photos(s, d), F.when(F.col("file_size") <= 1000, "too small"), "sizes")
    rows.write.parquet(work_dir(s, "observed"))
    return audit.observed_report(s, {"sizes": seen})


@register(PHOTOS_SQL, "select 'sizes' as step, count(*) filter (file_size > 1000) as done, count(*) filter (file_size <= 1000) as errors, count(*) as total from photos")
def streamed_run_report(s, d):
    """A11 of a stream of several batches, told by its listener."""
    import time

    base, report = work_dir(s, "watched"), audit.StreamReport()
    s.streams.addListener(report)
    try:
        rows = audit.observed_stream(_as_stream(s, views.photos(s, d), base, "id"), F.when(F.col("file_size") <= 1000, "too small"), "sizes")
        query = rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        until = time.time() + 30
        while len(report.batches.get("sizes", ())) < FILES and time.time() < until:  # events come a little later than the end
            time.sleep(0.1)
    finally:
        s.streams.removeListener(report)
    return report.report(s)


_NEAR = """select least(a.id, b.id) as photo_a, greatest(a.id, b.id) as photo_b, cast(bit_count(xor(('0x' || a.phash)::ubigint, ('0x' || b.phash)::ubigint)) as smallint) as hamming_distance
 from usable a join usable b on (b.captured_at > a.captured_at or (b.captured_at = a.captured_at and b.id > a.id)) and b.captured_at <= a.captured_at + interval 8 second
 where a.sha256 <> b.sha256 and bit_count(xor(('0x' || a.phash)::ubigint, ('0x' || b.phash)::ubigint)) <= 8"""
_USABLE = PHOTOS_SQL + "usable as (select * from photos where not missing and source = 'local'),"


@register(_USABLE, _NEAR)
def near_duplicates(s, d):
    return neardup.near_duplicates(views.photos(s, d))


@register(_USABLE, _NEAR)
def near_duplicates_banded(s, d):
    return neardup.near_duplicates_banded(views.photos(s, d))


_CROWD = PHOTOS_SQL + "usable as (select * replace (case when id % 3 = 0 then timestamp '1970-01-01' else captured_at end as captured_at, substr(phash, 1, 8) || lpad(lower(to_hex(id * 2654435761 % 4294967296)), 8, '0') as phash) from photos where not missing and source = 'local'),"


@register(_CROWD, _NEAR)
def near_duplicates_crowded(s, d):
    """J9 where a third of all photos bear one wrong date, with hashes at any distance."""
    i = F.col("id")
    wrong = F.when(i % 3 == 0, F.lit("1970-01-01").cast("timestamp")).otherwise(F.col("captured_at"))
    spread = F.concat(F.substring("phash", 1, 8), F.lpad(F.lower(F.hex(i * 2654435761 % 4294967296)), 8, "0"))
    p = views.photos(s, d).withColumn("captured_at", wrong).withColumn("phash", spread)
    return neardup.near_duplicates_dealt(p, hot=200)


@register(_USABLE + PAIRS_SQL + f"near as ({_NEAR}),", "select * from pairs union all select photo_a, photo_b, hamming_distance, false from near where (photo_a, photo_b) not in (select (photo_a, photo_b) from pairs)")
def merge_pairs(s, d):
    return neardup.merge_pairs(views.pairs(s, d), neardup.near_duplicates(views.photos(s, d)))


@register(PHOTOS_SQL, "select id, phash, 'malformed perceptual hash' as error from (select id, case when id % 5 = 0 then 'zz' else phash end as phash from photos) where phash = 'zz'")
def bad_phashes(s, d):
    p = views.photos(s, d).withColumn("phash", F.when(F.col("id") % 5 == 0, "zz").otherwise(F.col("phash")))
    return neardup.split_bad_phash(p)[1]


@register(PHOTOS_SQL, "select a.id as photo_a, b.id as photo_b from photos a join photos b on a.id < b.id and a.file_size // 100 = b.file_size // 100 and a.source = 'icloud' and b.source = 'icloud' and not a.missing and not b.missing and abs(epoch_us(a.captured_at) - epoch_us(b.captured_at)) <= 86400000000")
def remote_lookalikes(s, d):
    p = views.photos(s, d).withColumn("file_size", F.floor(F.col("file_size") / 100)).withColumn("remote_filename", F.when(F.col("source") == "icloud", "IMG.HEIC").otherwise(""))
    return neardup.remote_lookalikes(p, 86400)


_LIVE = "lv as (select id, relative_path, date_trunc('hour', captured_at) as t, media_type, regexp_extract(relative_path, '^(.*)/', 1) as dir, lower(regexp_extract(relative_path, '([^/]*)\\.[^.]*$', 1)) as stem from photos where not missing and source = 'local'), clips as (select dir, stem, max({'t': t, 'p': relative_path}) as c from lv where relative_path like '%.mov' group by dir, stem),"


@register(PHOTOS_SQL + _LIVE, "select id, clips.c.p as clip from lv join clips using (dir, stem) where media_type = 'image' and abs(epoch_us(t) - epoch_us(clips.c.t)) <= 1000000")
def live_pairs(s, d):
    p = views.photos(s, d).withColumn("captured_at", F.date_trunc("hour", "captured_at")).withColumn("live_photo_video_path", F.lit(None).cast("string"))
    return live.live_pairs(p)


@register(PHOTOS_SQL, "select id, live_photo_video_path as clip from photos where live_photo_video_path in (select relative_path from photos where not missing)")
def companions_kept(s, d):
    return live.clear_dangling_companions(views.photos(s, d)).filter("live_photo_video_path is not null").select("id", F.col("live_photo_video_path").alias("clip"))


_PATHS = r"""select doc_id, case when first in ('selected', 'rejected') then first else 'optional' end as status,
 case when len(rest) > 1 then rest[1] else '' end as provenance, case when lower(ext) in ('.mov', '.mp4', '.m4v', '.avi') then 'video' else 'image' end as media_type,
 case when contains(relative_path, '/') then regexp_extract(relative_path, '^(.*)/', 1) else '.' end as parent, lower(left(name, length(name) - length(ext))) as stem
 from (select *, string_split(relative_path, '/')[1] as first, case when string_split(relative_path, '/')[1] in ('selected', 'rejected') then string_split(relative_path, '/')[2:] else string_split(relative_path, '/') end as rest,
 regexp_extract(name, '[^.](\.[^.]+)$', 1) as ext from named_files)"""


@register(FILES_SQL, _PATHS)
def path_facts(s, d):
    p = "relative_path"
    return views.files(s, d).select("doc_id", paths.status_of(p).alias("status"), paths.provenance_of(p).alias("provenance"), paths.media_type_of(p).alias("media_type"), paths.parent_stem(p).alias("k")).select("doc_id", "status", "provenance", "media_type", "k.parent", "k.stem")


@register(FILES_SQL, r"select doc_id, relative_path from files where not regexp_matches(relative_path, '(^|/)\.') and regexp_matches(lower(relative_path), '\.(jpg|heic|mov)$')")
def media_files(s, d):
    return paths.filter_media(views.files(s, d)).select("doc_id", "relative_path")


_SIZE = "case when b >= 1099511627776 then printf('%.2f TB', b / 1099511627776.0) when b >= 1073741824 then printf('%.2f GB', b / 1073741824.0) when b >= 1048576 then printf('%.2f MB', b / 1048576.0) when b >= 1024 then printf('%.2f KB', b / 1024.0) else cast(b as varchar) || ' bytes' end"


@register(None, f"select o_orderkey, {_SIZE} as label from (select o_orderkey, cast(case o_orderkey % 3 when 0 then o_orderkey when 1 then round(o_totalprice) else round(o_totalprice) * 4096 end as bigint) as b from orders)")
def human_sizes(s, d):
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    size = F.when(k % 3 == 0, k).when(k % 3 == 1, F.round("o_totalprice").cast("long")).otherwise(F.round("o_totalprice").cast("long") * 4096)
    return o.select("o_orderkey", paths.human_size(size).alias("label"))


@register(None, "select c_custkey, coalesce(nullif(trim(regexp_replace(lower(trim(c_name)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'account') as slug, case when c_custkey % 3 = 0 then 'iCloud · ' || c_name when c_custkey % 3 = 1 then 'Local · ' || c_mktsegment else 'Local · root' end as label from customer")
def account_labels(s, d):
    k = F.col("c_custkey")
    c = table(s, d, "customer").withColumn("a", F.when(k % 3 == 0, F.col("c_name")).otherwise("")).withColumn("p", F.when(k % 3 == 1, F.col("c_mktsegment")).otherwise(""))
    return c.select("c_custkey", paths.account_slug("c_name").alias("slug"), paths.origin_label("a", "p").alias("label"))


@register(PHOTOS_SQL, "select id, '@src/' || coalesce(source_ref, 0) || '/' || relative_path as sentinel, relative_path as rel from photos")
def sentinels(s, d):
    p = views.photos(s, d).withColumn("sentinel", paths.sentinel(F.coalesce("source_ref", F.lit(0)), F.col("relative_path")))
    return p.select("id", "sentinel", paths.rel_from_sentinel("sentinel").alias("rel"))


@register(PHOTOS_SQL, "select id, case when source = 'icloud' then null when source_ref is null then '/lib/' || relative_path when source_ref < 2 then '/src/' || source_ref || '/' || relative_path end as abs_path, case when source = 'icloud' then 'remote' when source_ref >= 2 then 'no source' end as path_error from photos")
def resolved_paths(s, d):
    p = views.photos(s, d)
    p = p.withColumn("relative_path", F.when(F.col("source_ref").isNotNull(), paths.sentinel(F.col("source_ref"), F.col("relative_path"))).otherwise(F.col("relative_path")))
    roots = p.select("source_ref").filter("source_ref < 2").distinct().select(F.col("source_ref").alias("id"), F.concat(F.lit("/src/"), F.col("source_ref").cast("string")).alias("path"))
    return paths.resolve_paths(p, roots, "/lib").select("id", "abs_path", "path_error")


_NAMEDATE = r"""n as (select *, regexp_extract(name, '(^|[^0-9])(\d{4})(\d{2})(\d{2})_?(\d{2})(\d{2})(\d{2})($|[^0-9])', ['x', 'y', 'm', 'd', 'h', 'i', 's', 'z']) as a,
 regexp_extract(name, '(^|[^0-9])(\d{4})-(\d{2})-(\d{2})[ _](\d{2})[.:-](\d{2})[.:-](\d{2})($|[^0-9])', ['x', 'y', 'm', 'd', 'h', 'i', 's', 'z']) as b from named_files),
dated as (select *, coalesce(case when try_cast(a.y as int) between 1990 and 2100 and try_cast(a.s as int) <= 59 then try_cast(a.y || '-' || a.m || '-' || a.d || ' ' || a.h || ':' || a.i || ':' || a.s as timestamp) end,
 case when try_cast(b.y as int) between 1990 and 2100 and try_cast(b.s as int) <= 59 then try_cast(b.y || '-' || b.m || '-' || b.d || ' ' || b.h || ':' || b.i || ':' || b.s as timestamp) end) as from_name,
 case when right(t, 2) <> '60' then try_cast(replace(left(t, 10), ':', '-') || substr(t, 11) as timestamp) end as tag_time, case when right(raw_cd, 2) <> '60' then try_cast(replace(left(raw_cd, 10), ':', '-') || substr(raw_cd, 11) as timestamp) end as raw_time
 from (select *, case when coalesce(exif_datetime_original, '') <> '' then exif_datetime_original else exif_datetime end as t from n)),
chain as (select *, coalesce(case when coalesce(trim(raw_dto), '') = '' then raw_time end, tag_time) as tagged from dated),"""


@register(FILES_SQL + _NAMEDATE, "select doc_id, epoch_us(from_name) as us from dated")
def filename_dates(s, d):
    return views.files(s, d).select("doc_id", us(dates.filename_ts(paths.name_of("relative_path"))).alias("us"))


@register(FILES_SQL + _NAMEDATE, "select doc_id, epoch_us(coalesce(tagged, from_name, make_timestamp(cast(file_mtime * 1000000 as bigint)))) as us, case when tagged is not null then 'exif' when from_name is not null then 'filename' else 'file_mtime' end as source from chain")
def capture_dates(s, d):
    return dates.capture_date(views.files(s, d)).select("doc_id", us("captured_at").alias("us"), F.col("captured_at_source").alias("source"))


@register(FILES_SQL, "select doc_id, sha256(text) as sha256, sha1(encode(text)[1:65536] || encode(cast(file_size as varchar))) as content_key from files")
def content_hashes(s, d):
    return views.files(s, d).select("doc_id", F.sha2("content", 256).alias("sha256"), hashing.content_key(F.col("content"), F.col("file_size")).alias("content_key"))


@register(FILES_SQL, "select doc_id, sha256(text) as sha256, sha1(encode(text)[1:65536] || encode(cast(file_size as varchar))) as content_key from files")
def content_hashes_whole(s, d):
    """The same in the shape that callers know it by."""
    return views.files(s, d).select("doc_id", F.sha2("content", 256).alias("sha256"), hashing.content_key(F.col("content"), F.col("file_size")).alias("content_key"))


_TREE = FILES_SQL + r"""listed as (select 'd' || doc_id % 20 || '/' || doc_id || '/' || relative_path as relative_path, coalesce(text, '') as content from files where not regexp_matches(relative_path, '(^|/)\.') and regexp_matches(lower(relative_path), '\.(jpg|heic|mov)$')),"""


def _tree(s, d):
    from photolake.sources.tree import register_tree

    register_tree(s)
    root = views.tree(s, d)
    return root, s.read.format("media_tree").option("depth", 1).load(root)


@register(_TREE, "select relative_path, cast(octet_length(encode(content)) as bigint) as file_size from listed")
def listed_tree(s, d):
    """S1. Documents written as a tree of files, listed by the data source."""
    return _tree(s, d)[1].select("relative_path", "file_size")


@register(_TREE, "select relative_path, sha256(content) as sha256 from listed")
def hashed_tree(s, d):
    """H1. The tree's files hashed where they lie, dealt out by size."""
    root, listed = _tree(s, d)
    root = root.removeprefix("file://").removeprefix("file:")
    done = hashing.hash_by_size(listed.select(F.concat(F.lit(f"{root}/"), "relative_path").alias("abs_path"), "file_size"))
    return done.select(F.substring("abs_path", len(root) + 2, 1 << 20).alias("relative_path"), "sha256")


@register(FILES_SQL, "select doc_id as id, sha256(text) as sha256 from files where doc_id % 3 = 0 and doc_id % 7 <> 0")
def hash_pending(s, d):
    f = views.files(s, d)
    key = F.col("doc_id").cast("string").alias("relative_path")
    p = f.select(F.col("doc_id").alias("id"), key, F.lit("local").alias("source"), F.lit(False).alias("missing"), F.when(F.col("doc_id") % 3 > 0, "x").alias("sha256"))
    return hashing.hash_pending(p, f.filter("doc_id % 7 <> 0").select(key, "content"))[0]


_PHASH = """base as (select k, x, 2 * cos(pi() * k * (2 * x + 1) / 64) as c from range(8) a(k), range(32) b(x)),
v as (select vec_id, embedding as e from embeddings where len(embedding) = 64),
u as (select vec_id, k, sum(c * e[x + 1]::double) as u from v, base group by 1, 2), w as (select vec_id, k as l, sum(c * e[33 + x]::double) as w from v, base group by 1, 2),
low as (select vec_id, k, l, u * w as t from u join w using (vec_id)), cut as (select vec_id, median(t) as m from low group by 1),
bits as (select vec_id, k, sum(case when t > m then 1 << cast(7 - l as integer) else 0 end) as byte from low join cut using (vec_id) group by 1, 2),"""


@register(_PHASH, "select vec_id, p.phash from embeddings left join (select vec_id, string_agg(lpad(lower(to_hex(cast(byte as bigint))), 2, '0'), '' order by k) as phash from bits group by 1) p using (vec_id)")
def phash_of_vectors(s, d):
    """H3 of every vector, as a 32 x 32 image: the products of its first and its second half; none for vectors of another length."""
    v = table(s, d, "embeddings")
    e = F.col("embedding").cast("array<double>")
    image = F.flatten(F.transform(F.slice(e, 1, 32), lambda a: F.transform(F.slice(e, 33, 32), lambda b: a * b)))
    # The filter keeps the image a column of its own: a Python function can't be handed lambdas.
    images = v.select("vec_id", F.when(F.size(e) == 64, image).alias("image"), F.monotonically_increasing_id().alias("row")).filter("row >= 0")
    return images.select("vec_id", hashing.phash64(F.col("image")).alias("phash"))


@register(PHOTOS_SQL, "select id from photos where source = 'local' and not missing and media_type = 'image' and id % 4 = 0 and captured_at < timestamp '2024-01-16'")
def phash_worklist(s, d):
    p = views.photos(s, d).withColumn("phash", F.when(F.col("id") % 4 > 0, F.col("phash")))
    return hashing.phash_worklist(p, None, "2024-01-15").select("id")


_LISTED = "own as (select * from photos where source = 'local' and source_ref is null), listed as (select case when id % 6 = 0 then 'new/' || relative_path else relative_path end as relative_path, file_size, case when id % 9 = 0 then file_mtime + 100 when id % 9 = 1 then file_mtime else file_mtime end as file_mtime from own where id % 7 <> 0),"


def _listing(p: DataFrame) -> DataFrame:
    own = p.filter("source = 'local' and source_ref is null and id % 7 <> 0")
    i = F.col("id")
    return own.select(F.when(i % 6 == 0, F.concat(F.lit("new/"), "relative_path")).otherwise(F.col("relative_path")).alias("relative_path"), "file_size", F.when(i % 9 == 0, F.col("file_mtime") + 100).otherwise(F.col("file_mtime")).alias("file_mtime"), "captured_at", "captured_at_source")


@register(PHOTOS_SQL + _LISTED, "select relative_path, id, case when id is null then 'new' when l.file_size is null then 'vanished' when not missing and l.file_size = o.file_size and abs(l.file_mtime - o.file_mtime) < 1e-6 then 'unchanged' else 'changed' end as kind from own o full join listed l using (relative_path)")
def diff_listing(s, d):
    p = views.photos(s, d)
    return scan.diff_listing(p, _listing(p)).select("relative_path", "id", "kind")


@register(PHOTOS_SQL + _LISTED, "select relative_path, case when l.file_mtime is null then o.file_mtime else l.file_mtime end as file_mtime, case when l.file_mtime is null then o.missing else false end as missing, case when l.file_mtime is null then o.sha256 else o.sha256 end as sha256 from photos o full join listed l using (relative_path)")
def apply_listing(s, d):
    p = views.photos(s, d)
    return scan.apply_listing(p, _listing(p)).select("relative_path", "file_mtime", "missing", "sha256")


@register(PHOTOS_SQL + _LISTED, "select id, missing or (source = 'local' and source_ref is null and relative_path not in (select relative_path from listed)) as missing from photos")
def mark_missing(s, d):
    p = views.photos(s, d)
    return scan.mark_missing(p, scan.diff_listing(p, _listing(p)).filter("kind = 'vanished'")).select("id", "missing")


_MOVED = "v as (select *, row_number() over (partition by file_size, sha256 order by captured_at, id) as n from photos where id % 2 = 0), w as (select *, 'to/' || relative_path as path, row_number() over (partition by file_size, sha256 order by 'to/' || relative_path) as n from photos where id % 2 = 1),"


@register(PHOTOS_SQL + _MOVED, "select v.id, w.path as new_path from v join w using (file_size, sha256, n)")
def reconcile_hashed(s, d):
    p = views.photos(s, d).withColumn("file_mtime", F.lit(0.0)).withColumn("root_id", F.lit(None).cast("long"))
    return scan.reconcile_moves(p.filter("id % 2 = 0"), p.filter("id % 2 = 1").withColumn("relative_path", F.concat(F.lit("to/"), "relative_path")))


_MIXED = """gone as (select id, file_size as g, captured_at as t, case when id % 12 > 0 then sha256 end as h from photos where id % 2 = 0),
 free as (select 'to/' || relative_path as path, file_size as g, sha256 as h from photos where id % 2 = 1 and file_size in (select g from gone)),
 m as (select v.*, w.path, row_number() over (partition by v.g order by v.t, v.id) as s, (select count(*) from free f where f.g = v.g) as n
  from (select *, row_number() over (partition by g, h order by t, id) as r from gone where h is not null) v join (select *, row_number() over (partition by g, h order by path) as r from free) w using (g, h, r)),
 f as (select g, count(*) as n from free group by g),
 heir as (select b.g, min({'t': b.t, 'i': b.id}) as k from gone b join f using (g) left join m on m.g = b.g and m.s = f.n - 1 where b.h is null and (f.n = 1 or {'t': b.t, 'i': b.id} > {'t': m.t, 'i': m.id}) group by b.g),
 ruled as (select h.* from heir h join f using (g) where not exists (select 1 from m where m.g = h.g and m.s = f.n and {'t': m.t, 'i': m.id} < h.k)),
 last_free as (select r.g, r.k, e.path from ruled r join f using (g) join free e using (g) where not exists (select 1 from m where m.g = r.g and m.s < f.n and m.path = e.path)),"""


@register(PHOTOS_SQL + _MIXED, "select id, path as new_path from m where (g, path) not in (select (g, path) from last_free) union all select k.i, path from last_free")
def reconcile_mixed(s, d):
    """Some vanished rows have no hash."""
    p = views.photos(s, d).withColumn("file_mtime", F.lit(0.0)).withColumn("root_id", F.lit(None).cast("long"))
    gone = p.filter("id % 2 = 0").withColumn("sha256", F.when(F.col("id") % 12 > 0, F.col("sha256")))
    return scan.reconcile_moves(gone, p.filter("id % 2 = 1").withColumn("relative_path", F.concat(F.lit("to/"), "relative_path")))


_SRC = "own as (select * from photos where source_ref is not null), listed as (select source_ref, relative_path, file_size, file_mtime, case when id % 3 = 0 then 'selected' else 'optional' end as st from own where id % 7 <> 0 and source_ref < 3),"


@register(PHOTOS_SQL + _SRC, "select o.id, case when l.st is null then 'vanished' when not o.missing and o.status = l.st then 'unchanged' else 'changed' end as kind from own o left join listed l using (source_ref, relative_path) where source_ref in (select source_ref from listed)")
def scan_sources(s, d):
    p = views.photos(s, d).filter("source_ref is not null")
    listed = p.filter("id % 7 <> 0 and source_ref < 3").select(F.col("source_ref").alias("root_id"), "relative_path", "file_size", "file_mtime", "id")
    named = listed.filter("id % 3 = 0").select(F.col("root_id").alias("source_id"), "relative_path", F.lit("selected").alias("status"))
    p = p.withColumn("relative_path", paths.sentinel(F.col("source_ref"), F.col("relative_path")))
    roots = p.select(F.col("source_ref").alias("id")).distinct().select("id", F.lit("local").alias("kind"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("name"))
    return scan.scan_sources(p, listed.drop("id"), roots, named)[0].select("id", "kind")


@register(PHOTOS_SQL + _SRC, "select distinct source_ref as root_id, 's' || source_ref as name, 'unreachable' as error from own where source_ref not in (select source_ref from listed)")
def scan_source_errors(s, d):
    """J6. Sources of which nothing is listed."""
    p = views.photos(s, d).filter("source_ref is not null")
    listed = p.filter("id % 7 <> 0 and source_ref < 3").select(F.col("source_ref").alias("root_id"), "relative_path", "file_size", "file_mtime")
    roots = p.select(F.col("source_ref").alias("id")).distinct().select("id", F.lit("local").alias("kind"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("name"))
    none = listed.select(F.col("root_id").alias("source_id"), "relative_path", F.lit("selected").alias("status")).limit(0)
    return scan.scan_sources(p, listed, roots, none)[1]


_FOLD = ACTIONS_SQL + PHOTOS_SQL + """ok as (select a.*, p.sha256 from actions a join photos p on p.id = a.photo_id where not p.missing),
last as (select sha256, max_by(photo_id, {'t': ts, 'a': action_id}) as who, max_by(status, {'t': ts, 'a': action_id}) as st from ok group by sha256),
gone as (select distinct photo_id from ok where status <> 'optional'),"""


@register(_FOLD, """select id, new_status as status, case when status = 'optional' and (follows or id in (select photo_id from gone)) and original_path = '' and source = 'local' then relative_path else original_path end as original_path, new_status <> status as changed
 from (select p.*, coalesce(l.who is not null and p.id <> l.who and not p.missing, false) as follows, case when p.id = l.who then l.st when l.who is not null and not p.missing then 'rejected' else p.status end as new_status from photos p left join last l using (sha256))""")
def fold_actions(s, d):
    return decisions.fold_actions(views.photos(s, d), views.actions(s, d)).select("id", "status", "original_path", "changed")


@register(ACTIONS_SQL + PHOTOS_SQL, "select action_id, case when p.id is null then 'unknown photo' else 'conflict' end as error from actions a left join photos p on p.id = a.photo_id where p.id is null or p.missing")
def action_errors(s, d):
    return decisions.validate_actions(views.actions(s, d), views.photos(s, d))[1].select("action_id", "error")


@register(ACTIONS_SQL + PHOTOS_SQL, "select action_id, case when p.id is null then 'unknown photo' else 'conflict' end as error from actions a left join photos p on p.id = a.photo_id where p.id is null or p.missing or p.source_ref is not null")
def action_conflicts(s, d):
    """C1 with files of registered sources."""
    p = views.photos(s, d)
    own = F.when(F.col("source_ref").isNotNull(), paths.sentinel(F.col("source_ref"), F.col("relative_path"))).otherwise(F.col("relative_path"))
    return decisions.validate_actions(views.actions(s, d), p.withColumn("relative_path", own))[1].select("action_id", "error")


_RFOLD = ACTIONS_SQL + PHOTOS_SQL + "acts as (select a.*, p.account, p.remote_id from actions a join photos p on p.id = a.photo_id and p.source = 'icloud'), w as (select account, remote_id, max_by(status, {'t': ts, 'a': action_id}) as status from acts where status <> 'selected' group by 1, 2), old as (select account, remote_id, 'rejected' as status from photos where source = 'icloud' and id % 26 = 0),"


@register(_RFOLD, "select * from old where (account, remote_id) not in (select (account, remote_id) from w) union all select * from w where status <> 'optional'")
def remote_decisions(s, d):
    p = views.photos(s, d)
    old = p.filter("source = 'icloud' and id % 26 = 0").select("account", "remote_id", F.lit("rejected").alias("status"))
    return decisions.fold_remote_actions(p, old, views.actions(s, d))[1]


_RES = "r as (select photo_a as action_id, photo_a, photo_b, ['keep_left', 'keep_right', 'keep_both', 'defer', 'what'][1 + photo_a % 5] as action from pairs where photo_a % 4 = 0),"


@register(PHOTOS_SQL + PAIRS_SQL + _RES, "select action_id * 2 as action_id, case action when 'keep_left' then photo_a else photo_b end as photo_id, 'selected' as status from r where action in ('keep_left', 'keep_right') union all select action_id * 2 + 1, case action when 'keep_left' then photo_b else photo_a end, 'rejected' from r where action in ('keep_left', 'keep_right')")
def pair_resolutions(s, d):
    pairs = views.pairs(s, d)
    names = F.array(*(F.lit(x) for x in ("keep_left", "keep_right", "keep_both", "defer", "what")))
    r = pairs.filter("photo_a % 4 = 0").select(F.col("photo_a").alias("action_id"), F.lit("2024-02-01").cast("timestamp").alias("ts"), "photo_a", "photo_b", F.element_at(names, (1 + F.col("photo_a") % 5).cast("int")).alias("action"))
    return decisions.resolve_pairs(pairs, r)[1].select("action_id", "photo_id", "status")


_DEST = r"""p as (select id, case id % 3 when 0 then 'selected/' when 1 then 'rejected/' else '' end || case when id % 4 = 0 then '' else 'a/' end || 'x' || id || '.jpg' as path, case when id % 5 = 0 then 'o/x.jpg' else '' end as orig, provenance, ['selected', 'rejected', 'optional'][1 + id % 7 % 3] as st from photos),
q as (select *, regexp_extract(path, '[^/]*$') as name, case when path like 'selected/%' or path like 'rejected/%' then substr(path, 10) else path end as rest, path like 'selected/%' as sel, path like 'selected/%' or path like 'rejected/%' as placed from p),
o as (select *, case when orig <> '' then orig when not placed then path when contains(rest, '/') then rest when provenance <> '' then provenance || '/' || name else name end as origin from q),"""


@register(PHOTOS_SQL + _DEST, "select id, case st when 'selected' then 'selected/' || name when 'rejected' then 'rejected/' || case when sel then origin else rest end else origin end as dest from o")
def destinations(s, d):
    i = F.col("id")
    top = F.when(i % 3 == 0, "selected/").when(i % 3 == 1, "rejected/").otherwise("")
    path = F.concat(top, F.when(i % 4 == 0, "").otherwise("a/"), F.lit("x"), i.cast("string"), F.lit(".jpg"))
    st = F.element_at(F.array(F.lit("selected"), F.lit("rejected"), F.lit("optional")), (1 + i % 7 % 3).cast("int"))
    return views.photos(s, d).select("id", moves.dest_path(path, F.when(i % 5 == 0, "o/x.jpg").otherwise(""), F.col("provenance"), st).alias("dest"))


_NUMBERED = "case when n = 0 then path else regexp_replace(path, '(\\.[a-z]+)$', ' (' || n || ')\\1') end"


@register(
    PHOTOS_SQL + "asked as (select id as key, 'selected/IMG_' || id % 997 || '.jpg' as path from photos), there as (select distinct path from asked where key % 10 = 0),",
    f"select key, {_NUMBERED} as final_path from (select key, path, row_number() over (partition by path order by key) - 1 + case when path in (select path from there) then 1 else 0 end as n from asked)",
)
def unique_names(s, d):
    """Photos flattened into one folder by a few names, so that most clash."""
    p = views.photos(s, d)
    plan = p.select(F.col("id").alias("key"), F.col("id").alias("ord"), F.concat(F.lit("selected/IMG_"), (F.col("id") % 997).cast("string"), F.lit(".jpg")).alias("path"))
    there = p.filter("id % 10 = 0").select(F.concat(F.lit("selected/IMG_"), (F.col("id") % 997).cast("string"), F.lit(".jpg")).alias("path")).distinct()
    return moves.assign_unique(plan, there).select("key", "final_path")


@register()
def unique_names_mixed(s, d):
    """U2 where names clash with numbered forms of others: photos dealt over few names of 50 folders. Tests hold it against taking names one by one."""
    i = F.col("id")
    name = F.element_at(F.array(*map(F.lit, ("a.jpg", "a (1).jpg", "a (2).jpg", "a (1) (1).jpg", "a.jpg", "a (40).jpg", "a.jpg"))), (i % 7 + 1).cast("int"))
    p = views.photos(s, d).select(i.alias("key"), i.alias("ord"), F.concat(F.lit("d"), (F.floor(i / 7) % 50).cast("string"), F.lit("/"), name).alias("path"))
    there = p.filter("key % 11 = 0").select(F.concat(F.lit("d"), (F.col("key") % 50).cast("string"), F.lit("/a ("), (F.col("key") % 30 + 1).cast("string"), F.lit(").jpg")).alias("path"))
    return moves.assign_unique(p, there).select("key", "final_path")


@register(
    PHOTOS_SQL + """moved as (select id, relative_path as from_path, live_photo_video_path as clip from photos where status = 'optional' and source = 'local' and not missing),
      rws as (select id, 'image' as role, from_path, id * 2 as key from moved union all select id, 'companion', clip, id * 2 + 1 from moved where clip in (select relative_path from photos where not missing)),
      ranked as (select *, 'selected/' || regexp_extract(from_path, '[^/]*$') as path from rws),""",
    f"select id, role, from_path, {_NUMBERED} as to_path from (select *, row_number() over (partition by path order by key) - 1 as n from ranked)",
)
def move_plan(s, d):
    p = views.photos(s, d)
    there = p.filter("not missing").select(F.col("relative_path").alias("path"))
    return moves.plan_moves(p, p.filter("status = 'optional'").select("id", F.lit("selected").alias("new_status")), there)


@register(
    PHOTOS_SQL + f"""moved as (select id, relative_path as from_path, live_photo_video_path as clip from photos where status = 'optional' and source = 'local' and not missing),
      rws as (select id, 'image' as role, from_path, id * 2 as key from moved union all select id, 'companion', clip, id * 2 + 1 from moved where clip in (select relative_path from photos where not missing) and clip not in (select from_path from moved)),
      ranked as (select *, 'selected/' || regexp_extract(from_path, '[^/]*$') as path from rws),
      plan as (select from_path, {_NUMBERED} as to_path from (select *, row_number() over (partition by path order by key) - 1 as n from ranked)),""",
    """select p.id, coalesce(m.to_path, p.relative_path) as relative_path, case when m.to_path is not null then 'selected' else p.status end as status, coalesce(c.to_path, p.live_photo_video_path) as clip,
     case when m.to_path is not null and p.status = 'optional' and p.original_path = '' then p.relative_path else p.original_path end as original_path from photos p left join plan m on m.from_path = p.relative_path left join plan c on c.from_path = p.live_photo_video_path""",
)
def moves_applied(s, d):
    """U3. The catalog after the plan's moves; clips that move as rows of their own aren't moved again as companions."""
    p = views.photos(s, d)
    there = p.filter("not missing").select(F.col("relative_path").alias("path"))
    own = p.filter("status = 'optional'").select("id", F.lit("selected").alias("new_status"))
    going = p.filter("status = 'optional' and source = 'local' and not missing").select(F.col("relative_path").alias("live_photo_video_path"), F.lit(True).alias("_goes"))
    single = left_join_sparse(p, going, ["live_photo_video_path"], "id").withColumn("live_photo_video_path", F.when(F.col("_goes").isNull(), F.col("live_photo_video_path"))).select(*p.columns)
    plan = moves.plan_moves(single, own, there)
    return moves.apply_moves(p, plan).select("id", "relative_path", "status", F.col("live_photo_video_path").alias("clip"), "original_path")


_FLAT = """deep as (select *, case when id % 2 = 0 then 'selected/' || relative_path else relative_path end as was from photos),
 named as (select was, 'selected/IMG_' || (id // 2) // 7 || '.jpg' as path from deep where id % 2 = 0),
 flat as (select was, case when n = 0 then path else left(path, length(path) - 4) || ' (' || n || ').jpg' end as went from (select was, path, row_number() over (partition by path order by was) - 1 as n from named)),"""


def _flattened(s, d):
    """Images lie under selected/, in folders, under names that many share."""
    i = F.col("id")
    shared = F.concat(F.lit("selected/"), paths.parent_of("relative_path"), F.lit("/"), i.cast("string"), F.lit("/IMG_"), F.floor(F.floor(i / 2) / 7).cast("string"), F.lit(".jpg"))
    p = views.photos(s, d).withColumn("relative_path", F.when(i % 2 == 0, shared).otherwise(F.col("relative_path"))).withColumn("original_path", F.lit(""))
    got = p.filter("id % 4 = 0").select("account", F.col("id").cast("string").alias("remote_id"), "relative_path")
    return moves.plan_flatten(p, p.select("relative_path"), got)


_WENT = _FLAT.replace("'selected/' || relative_path else", "'selected/' || regexp_extract(relative_path, '^(.*)/', 1) || '/' || id || '/IMG_' || (id // 2) // 7 || '.jpg' else")


@register(PHOTOS_SQL + _WENT, "select p.id, coalesce(f.went, p.was) as relative_path, case when f.went is not null then substr(p.was, 10) else '' end as original_path from deep p left join flat f using (was)")
def flattened_catalog(s, d):
    """U4. The catalog after its moves, with names that clash."""
    return _flattened(s, d)[1].select("id", "relative_path", "original_path")


@register(PHOTOS_SQL + _WENT, "select cast(p.id as varchar) as remote_id, f.went as relative_path from deep p join flat f using (was) where p.id % 4 = 0")
def flattened_downloads(s, d):
    """U4. What accounts have landed, after the moves."""
    return _flattened(s, d)[2].select("remote_id", "relative_path")


@register(PHOTOS_SQL, "select 'selected/' || relative_path as from_path, 'selected/' || regexp_extract(relative_path, '[^/]*$') as to_path from photos")
def flatten_plan(s, d):
    p = views.photos(s, d).withColumn("relative_path", F.concat(F.lit("selected/"), "relative_path"))
    return moves.plan_flatten(p, p.select("relative_path"), p.filter("remote_id is not null").select("account", "remote_id", "relative_path"))[0]


_EXPORT = "f as (select id, 'selected/' || regexp_extract(relative_path, '[^/]*$') as path, file_size, file_mtime from photos where not missing),"


@register(PHOTOS_SQL + _EXPORT, "select action, count(*) as n from (select case when id % 3 = 0 then 'skip' else 'copy' end as action from f) group by 1")
def export_counts(s, d):
    return moves.export_report(_export(s, d))


def _export(s, d, only=None):
    f = views.photos(s, d).filter("not missing").select("id", F.concat(F.lit("selected/"), paths.name_of("relative_path")).alias("relative_path"), "file_size", "file_mtime", "captured_at")
    there = f.filter("id % 3 = 0").select(paths.name_of("relative_path").alias("name"), "file_size", (F.col("file_mtime") + 1).alias("file_mtime"))
    return moves.plan_export(f, f, there.unionByName(f.filter("id % 3 = 1").select(paths.name_of("relative_path").alias("name"), F.lit(-1).cast("long").alias("file_size"), "file_mtime")), only=only)


@register(_RFOLD, "select * from old where (account, remote_id) not in (select (account, remote_id) from w) union all select * from w where status <> 'optional'")
def decisions_written(s, d):
    """C7. The accounts' decisions after local and remote actions together."""
    p = views.photos(s, d)
    old = p.filter("source = 'icloud' and id % 26 = 0").select("account", "remote_id", F.lit("rejected").alias("status"))
    return decisions.apply_decisions(p, old, views.actions(s, d))[1]


@register(PHOTOS_SQL + _EXPORT, "select path as relative_path, case when id % 3 = 0 then 'skip' else 'copy' end as action, case when id % 3 = 1 then regexp_replace(substr(path, 10), '(\\.[a-z]+)$', ' (1)\\1') else substr(path, 10) end as target from f")
def export_plan(s, d):
    return _export(s, d)


@register(PHOTOS_SQL, "select id, strftime(captured_at, '%Y-%m-%d') || '_' || regexp_extract(relative_path, '[^/]*$') as dated, case when remote_filename <> '' then replace(remote_filename, '.HEIC', case when id % 2 = 0 then '.png' else '.jpg' end) else coalesce(remote_id, 'r') || '.jpg' end as target from photos")
def target_names(s, d):
    dated = paths.export_name(paths.name_of("relative_path"), F.col("captured_at"), True)
    target = paths.remote_target_name(F.col("remote_filename"), F.coalesce("remote_id", F.lit("r")), F.col("id") % 2 == 0)
    return views.photos(s, d).select("id", dated.alias("dated"), target.alias("target"))


@register(PHOTOS_SQL, "select id, 'n' || id as target, case when status = 'selected' and not missing then (case when id % 4 = 0 then 'restore' else 'keep' end) when id % 4 = 0 then 'gone' when id % 4 = 1 then 'modified' else 'remove' end as action from photos")
def export_reconciliation(s, d):
    p = views.photos(s, d)
    ledger = p.select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), "file_size", "file_mtime")
    there = ledger.filter("id % 4 <> 0").select("name", F.when(F.col("id") % 4 == 1, F.col("file_size") + 1).otherwise(F.col("file_size")).alias("file_size"), "file_mtime")
    return moves.reconcile_export(p, ledger, there)


@register(FILES_SQL, "select doc_id as source_id, relative_path, string_split(relative_path, '/')[1] as status from files where doc_id % 6 in (0, 1)")
def adopted_statuses(s, d):
    return moves.adopt_statuses(views.files(s, d).select(F.col("doc_id").alias("root_id"), "relative_path"))


_SLUG = "trim(regexp_replace(lower(trim(account)), '[^a-z0-9]+', '-', 'g'), '-')"


@register(REMOTE_SQL, f"select '@icloud/' || account || '/' || remote_id as relative_path, case when (account, remote_id) in (select (account, remote_id) from decisions) then 'rejected' else 'optional' end as status, {_SLUG} as provenance, size as file_size, epoch_us(captured_at) as captured_us, media_type, filename as remote_filename from items")
def remote_pull(s, d):
    named, got = views.remote_state(s, d)
    items = remote.new_items(views.photos(s, d), remote.read_remote_listing(views.remote_listing(s, d)), got)
    return remote.remote_rows(items, named).select("relative_path", "status", "provenance", "file_size", us("captured_at").alias("captured_us"), "media_type", "remote_filename")


@register(PHOTOS_SQL, "select id, account, remote_id from photos where source = 'icloud' and status = 'selected' and id % 4 <> 0 and account in ('acct-1', 'acct-2', 'acct-3')")
def download_queue(s, d):
    p = views.photos(s, d)
    got = p.filter("source = 'icloud' and id % 4 = 0").select("account", "remote_id")
    up = p.select("account").distinct().filter(F.col("account").isin("acct-1", "acct-2", "acct-3"))
    return remote.download_queue(p, got, up)[0].select("id", "account", "remote_id")


@register(PHOTOS_SQL, "select id, case when media_type = 'video' then 'thumb_image' else 'thumb' end as variant, case when captured_at >= timestamp '2024-01-10' then 0 else 1 end as prio from photos where source = 'icloud' and (id % 3 <> 0 or (media_type = 'video' and id % 5 = 0))")
def preview_worklist(s, d):
    p = views.photos(s, d)
    have = p.filter("source = 'icloud' and id % 3 = 0").select("account", "remote_id", (F.col("id") % 5 > 0).alias("is_jpeg"))
    return remote.preview_worklist(p, have, "2024-01-10").select("id", "variant", "prio")


@register(PHOTOS_SQL, "select id, case when source = 'icloud' and id % 2 = 0 then 'local' else source end as source, case when source = 'icloud' and id % 2 = 0 then 'selected/' || remote_id || '.jpg' else relative_path end as relative_path, epoch_us(captured_at) as captured_us from photos")
def landed_downloads(s, d):
    p = views.photos(s, d)
    none = p.filter("source = 'icloud' and id % 2 = 0").select("account", "remote_id", F.concat(F.lit("selected/"), "remote_id", F.lit(".jpg")).alias("relative_path"), F.lit(1).cast("long").alias("file_size"), F.lit(2.0).alias("file_mtime"))
    landed = none.select("*", F.lit(None).cast("string").alias("clip_path"), F.lit(None).cast("long").alias("clip_size"), F.lit(None).cast("double").alias("clip_mtime"))
    empty = landed.select("account", "remote_id", "relative_path").limit(0)
    rows = remote.land_downloads(p, landed, empty, landed.select("account", "remote_id", F.lit("rejected").alias("status")))[0]
    return rows.select("id", "source", "relative_path", us("captured_at").alias("captured_us"))


@register(PHOTOS_SQL + "got as (select * from photos where source = 'icloud' and id % 2 = 0),", """select p.relative_path as was, case when g.id is not null then 'local' else p.source end as source, case when g.id is not null then 'selected/' || p.remote_id || '.jpg' else p.relative_path end as relative_path,
 case when g.id is not null and p.id % 4 = 0 then 'selected/' || p.remote_id || '.mov' else p.live_photo_video_path end as clip from photos p left join got g using (id)
 union all select null, 'local', 'selected/' || remote_id || '.mov', null from got where id % 4 = 0""")
def landed_clips(s, d):
    """R4. Every second landed item brings a motion clip, which becomes a row of its own."""
    p = views.photos(s, d)
    clip = F.when(F.col("id") % 4 == 0, F.concat(F.lit("selected/"), "remote_id", F.lit(".mov")))
    landed = p.filter("source = 'icloud' and id % 2 = 0").select("account", "remote_id", F.concat(F.lit("selected/"), "remote_id", F.lit(".jpg")).alias("relative_path"), F.lit(1).cast("long").alias("file_size"), F.lit(2.0).alias("file_mtime"), clip.alias("clip_path"), F.when(clip.isNotNull(), 3).cast("long").alias("clip_size"), F.when(clip.isNotNull(), 4.0).alias("clip_mtime"))
    none = landed.select("account", "remote_id", "relative_path").limit(0)
    rows = remote.land_downloads(p, landed, none, landed.select("account", "remote_id", F.lit("rejected").alias("status")))[0]
    was = p.select("id", F.col("relative_path").alias("was"))
    return rows.join(was, "id", "left").select("was", "source", "relative_path", F.col("live_photo_video_path").alias("clip"))


@register(PHOTOS_SQL, "select 'acct-1' as account, count(*) filter (account = 'acct-1') as rows_removed, count(*) filter (account in ('acct-1', 'acct-2') and id % 3 <> 0 and account = 'acct-1') * 2 as previews_removed from photos where source = 'icloud'")
def disconnect_report(s, d):
    """R5. Rows and cached previews of two tiers that go with an account."""
    p = views.photos(s, d)
    names = F.array(*(F.concat(F.lit("icloud-"), paths.account_slug("account"), F.lit("-"), "remote_id", F.lit(f"-{tier}.jpg")) for tier in ("thumb", "medium")))
    previews = p.filter("source = 'icloud' and account in ('acct-1', 'acct-2') and id % 3 <> 0").select(F.explode(names).alias("name"))
    return remote.disconnect_plan(p, previews, "acct-1")[2]


@register(PHOTOS_SQL, "select id from photos where not (source = 'icloud' and account = 'acct-1')")
def disconnected(s, d):
    return remote.disconnect(views.photos(s, d), "acct-1")[0].select("id")


@register(PHOTOS_SQL, "select account, epoch_us(case when account in ('acct-1', 'acct-2') then max(captured_at) else timestamp '2024-01-05' end) as cursor_us from photos where account <> '' group by account")
def advanced_cursors(s, d):
    p = views.photos(s, d).filter("account <> ''")
    states = p.select("account").distinct().withColumn("cursor", F.lit("2024-01-05").cast("timestamp"))
    full = p.select("account").distinct().filter(F.col("account").isin("acct-1", "acct-2"))
    return remote.advance_cursor(states, p, full).select("account", us("cursor").alias("cursor_us"))


_ENTRIES = "select account, 'decision' as kind, remote_id as key, status as value from photos where source = 'icloud' and id % 2 = 0 and status <> 'optional' union all select account, 'download', remote_id, relative_path from photos where source = 'icloud' and id % 2 = 1"


def _account_documents(s, d):
    """Documents of at most 100 entries, so that accounts have several."""
    p = views.photos(s, d).filter("source = 'icloud'")
    states = p.groupBy("account").agg(F.max("captured_at").alias("cursor"))
    return state.account_documents(states, p.filter("id % 2 = 0").select("account", "remote_id", "status"), p.filter("id % 2 = 1").select("account", "remote_id", "relative_path"), 100)


@register(PHOTOS_SQL, f"{_ENTRIES} union all select account, 'large documents', null, '0' from photos where source = 'icloud' group by account")
def account_documents(s, d):
    """S6. What the documents hold, and how many are too large."""
    docs = _account_documents(s, d)
    each = lambda kind, c: docs.select("account", F.lit(kind).alias("kind"), F.explode(c).alias("key", "value"))
    large = docs.groupBy("account").agg(F.count_if((F.size("decisions") > 100) | (F.size("downloaded") > 100)).cast("string").alias("value"))
    return each("decision", "decisions").unionByName(each("download", "downloaded")).unionByName(large.select("account", F.lit("large documents").alias("kind"), F.lit(None).cast("string").alias("key"), "value"))


@register(None, "select cast(ts as date) as day, count(*) as n from events group by 1")
def streamed_daily_counts(s, d):
    """W5 run over the event table as a stream until it has seen all of it."""
    from photolake.streaming.jobs import stream_daily_counts

    s.conf.set("spark.sql.session.timeZone", "UTC")
    base = work_dir(s, "daily")
    rows = _as_stream(s, table(s, d, "events"), base, "event_id").select(F.col("ts").cast("timestamp").alias("captured_at"))
    counted = stream_daily_counts(rows, "3650 days")
    # Update mode: a day's row comes again whenever it grows, and the newest counts.
    write = lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/rows/batch={n}")
    counted.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.option("basePath", f"{base}/rows").parquet(f"{base}/rows").groupBy(F.to_date("day").alias("day")).agg(F.max_by("n", "batch").alias("n"))


#: Batches that registered streams deal their table into, partitions of their tables, and rows that suit one file.
FILES, PARTS, FILE_ROWS = 3, 8, 250_000


def _as_stream(s, rows, base, key):
    """The rows as a stream of FILES batches, dealt by the key's hash and so in no order of time; a batch has as many files as its rows need."""
    each = max(1, -(-rows.count() // (FILES * FILE_ROWS)))
    rows.repartition(FILES * each, key).write.parquet(f"{base}/in")
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(f"{base}/in")


@register(REMOTE_SQL, f"select '@icloud/' || account || '/' || remote_id as relative_path, case when (account, remote_id) in (select (account, remote_id) from decisions) then 'rejected' else 'optional' end as status, {_SLUG} as provenance, size as file_size, epoch_us(captured_at) as captured_us from items")
def streamed_pull(s, d):
    """W1."""
    from photolake.streaming import jobs

    named, got = views.remote_state(s, d)
    photos, base = views.photos(s, d), work_dir(s, "pull")
    jobs.start_catalog(photos, base, PARTS)
    jobs.start_remote_state(got, named, base, PARTS)
    # An item listed twice comes in one file, as one pull has it: of repeats the first listed counts.
    rows = _as_stream(s, remote.read_remote_listing(views.remote_listing(s, d)), base, "remote_id")
    jobs.stream_pull(rows, base, photos, got, named, f"{base}/check", PARTS).awaitTermination()
    out = jobs.read_catalog(s, base, photos)
    return out.filter("relative_path like '@icloud/%'").select("relative_path", "status", "provenance", "file_size", us("captured_at").alias("captured_us"))


@register(_FOLD, """select id, case when id = l.who then l.st when l.who is not null and not missing then 'rejected' else status end as status from photos left join last l using (sha256)""")
def streamed_decisions(s, d):
    """W2."""
    from photolake.streaming import jobs

    photos, base = views.photos(s, d), work_dir(s, "decisions")
    jobs.start_groups(photos, base, PARTS)
    jobs.key_actions(_as_stream(s, views.actions(s, d), base, "action_id"), base, f"{base}/keyed", f"{base}/check-1", PARTS).awaitTermination()
    keyed = s.readStream.schema(jobs.KEYED).option("maxFilesPerTrigger", 4).parquet(f"{base}/keyed/*")
    jobs.stream_decisions(keyed, base, photos, f"{base}/check-2", PARTS).awaitTermination()
    return jobs.read_catalog(s, base, photos).select("id", "status")


@register(_USABLE, _NEAR)
def streamed_near_duplicates(s, d):
    """W3."""
    from photolake.streaming.jobs import stream_near_duplicates

    base = work_dir(s, "near")
    stream_near_duplicates(_as_stream(s, views.photos(s, d), base, "id"), base, f"{base}/check").awaitTermination()
    return s.read.parquet(f"{base}/pairs").select("photo_a", "photo_b", "hamming_distance")


@register(_USABLE, _NEAR)
def streamed_near_duplicates_bounded(s, d):
    """W3 with a watermark, wide enough for rows in no order of time."""
    from photolake.streaming.jobs import stream_near_duplicates_bounded

    base = work_dir(s, "bounded")
    found = stream_near_duplicates_bounded(_as_stream(s, views.photos(s, d), base, "id"), "3650 days")
    found.writeStream.format("parquet").option("path", f"{base}/pairs").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(found.schema).parquet(f"{base}/pairs")


_ARRIVING = "relative_path string, file_size long, file_mtime double, captured_at timestamp, captured_at_source string, sha256 string, snapshot string, total long"


def _arriving(rows, snapshot=None):
    cols = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("relative_path", "file_size", "file_mtime", "captured_at", "captured_at_source", "sha256")]
    return rows.select(*cols, F.lit(snapshot).cast("string").alias("snapshot"), F.lit(None).cast("long").alias("total"))


@register(PHOTOS_SQL + _LISTED, "select relative_path, case when l.file_mtime is null then o.file_mtime else l.file_mtime end as file_mtime, case when l.file_mtime is null then o.missing else false end as missing from photos o full join listed l using (relative_path)")
def streamed_listing(s, d):
    """W4, new and changed files."""
    from photolake.streaming import jobs

    photos, base = views.photos(s, d), work_dir(s, "listing")
    jobs.start_catalog(photos, base, PARTS)
    jobs.stream_listing(_as_stream(s, _arriving(_listing(photos)), base, "relative_path"), base, photos, f"{base}/check", PARTS).awaitTermination()
    return jobs.read_catalog(s, base, photos).select("relative_path", "file_mtime", "missing")


_SNAPSHOTS = """own as (select *, 1700000000.0::double + id as m, 'selected/moved/' || id || '.jpg' as away from photos where source = 'local' and source_ref is null),
states as (select *, id % 5 <> 0 as known, id % 5 <> 0 or id % 7 <> 0 as kept, id % 7 <> 1 as there, id % 6 = 0 as moves, id % 9 = 0 as changes from own),"""


@register(
    PHOTOS_SQL + _SNAPSHOTS,
    """select case when there and moves and not changes then away else relative_path end as relative_path, case when known then id end as old_id, not there or (moves and changes) as missing, m + case when there and not moves and changes then 100 else 0 end as file_mtime
 from states where kept or (there and not (moves and changes)) union all select away, null, false, m + 100 from states where there and moves and changes""",
)
def streamed_snapshots(s, d):
    """W4. Two whole listings, dealt over several files, with rows of the second before the first one's marker: changed, new, vanished and moved files."""
    from photolake.streaming import jobs

    i = F.col("id")
    p = views.photos(s, d)
    own = p.filter("source = 'local' and source_ref is null").withColumn("file_mtime", F.lit(1.7e9) + i)
    start, base = own.filter("id % 5 <> 0"), work_dir(s, "snapshots")
    jobs.start_catalog(start, base, PARTS)
    first = own.filter("id % 7 <> 0")
    away = F.concat(F.lit("selected/moved/"), i.cast("string"), F.lit(".jpg"))
    second = own.filter("id % 7 <> 1").withColumn("relative_path", F.when(i % 6 == 0, away).otherwise(F.col("relative_path"))).withColumn("file_mtime", F.col("file_mtime") + F.when(i % 9 == 0, 100).otherwise(0))
    marker = lambda rows, name: s.createDataFrame([(None, None, None, None, None, None, name, rows.count())], _ARRIVING)
    odd = F.col("file_size") % 2 == 1
    arrivals = [_arriving(first.filter(odd), "1"), _arriving(second.filter(odd), "2"), _arriving(first.filter(~odd), "1").unionByName(marker(first, "1")), marker(second, "2"), _arriving(second.filter(~odd), "2")]
    each = max(1, -(-own.count() // (2 * FILE_ROWS)))
    for k, rows in enumerate(arrivals):
        # The third has the marker beside its rows, the fourth is a marker alone.
        (rows.coalesce(1) if each == 1 or k == 3 else rows.repartition(each)).write.parquet(f"{base}/in/{k}")
    stream = s.readStream.schema(_ARRIVING).option("maxFilesPerTrigger", each).parquet(f"{base}/in/*")
    jobs.stream_listing(stream, base, p, f"{base}/check", PARTS).awaitTermination()
    top = start.agg(F.max("id")).first()[0]
    return jobs.read_catalog(s, base, p).select("relative_path", F.when(i <= top, i).alias("old_id"), "missing", "file_mtime")


@register(PHOTOS_SQL, f"{_ENTRIES} union all select account, 'cursor', null, cast(max(epoch_us(captured_at)) as varchar) from photos where source = 'icloud' group by account")
def account_states_read_back(s, d):
    """S3, S6. What was written for each account, read again: the second version, as the first doesn't count any more."""
    base = work_dir(s, "states")
    docs = _account_documents(s, d)
    state.write_account_states(docs.limit(1), base)
    states, named, got, _ = state.read_account_states(s, state.write_account_states(docs, base))
    one = lambda df, kind, key, value: df.select("account", F.lit(kind).alias("kind"), key.cast("string").alias("key"), value.cast("string").alias("value"))
    out = one(named, "decision", F.col("remote_id"), F.col("status")).unionByName(one(got, "download", F.col("remote_id"), F.col("relative_path")))
    return out.unionByName(one(states, "cursor", F.lit(None), us("cursor")))


@register(PHOTOS_SQL, "select source_ref as source_id, relative_path, status from photos where source_ref is not null and status <> 'optional'")
def source_states_read_back(s, d):
    """S5, S6."""
    p = views.photos(s, d).filter("source_ref is not null")
    sources = p.select(F.col("source_ref").alias("id"), F.concat(F.lit("disk-"), F.col("source_ref").cast("string")).alias("name")).distinct()
    docs = state.source_documents(sources, p.select(F.col("source_ref").alias("source_id"), "relative_path", "status"))
    return state.read_source_states(s, state.write_states(docs, work_dir(s, "sources")), sources)[0].select("source_id", "relative_path", "status")


@register(PHOTOS_SQL, """select id, case when id % 4 = 0 then 'selected/moved/' || id || '.jpg' else relative_path end as relative_path, case when id % 4 = 0 then false else missing end as missing,
 case when id % 4 = 0 and source_ref is null then 'selected' else status end as status, case when id % 4 = 0 and source_ref is null then 'moved' else provenance end as provenance from photos""")
def relinked(s, d):
    """J5."""
    p = views.photos(s, d)
    to = p.filter("id % 4 = 0").select("id", F.concat(F.lit("selected/moved/"), F.col("id").cast("string"), F.lit(".jpg")).alias("new_path"))
    placeholder = p.filter("id % 8 = 0").withColumn("relative_path", F.concat(F.lit("selected/moved/"), F.col("id").cast("string"), F.lit(".jpg"))).withColumn("id", -1 - F.col("id"))
    return scan.relink(p.unionByName(placeholder), to).select("id", "relative_path", "missing", "status", "provenance")


_BY_ID = "by_id as (select id // 2 as cid, max_by(relative_path, {'t': captured_at, 'p': relative_path}) as clip from photos where not missing and source = 'local' and media_type = 'video' and id % 6 <> 1 group by 1),"


@register(PHOTOS_SQL + _BY_ID, """select i.id, coalesce(b.clip, v.relative_path) as clip from photos i left join by_id b on b.cid = i.id // 2
 left join photos v on v.id = i.id + 1 and not v.missing and v.source = 'local' and abs(epoch_us(i.captured_at) - epoch_us(v.captured_at)) <= 1000000
 where i.media_type = 'image' and not i.missing and i.source = 'local' and coalesce(b.clip, v.relative_path) is not null""")
def live_pairs_by_identifier(s, d):
    """J13. Two thirds of the clips carry their image's identifier, the others pair by name."""
    p = views.photos(s, d).withColumn("live_photo_video_path", F.lit(None).cast("string"))
    cid = F.when(~((F.col("media_type") == "video") & (F.col("id") % 6 == 1)), F.floor(F.col("id") / 2))
    return live.live_pairs(p.withColumn("content_id", cid), "content_id")


_LOCAL_FOLD = ACTIONS_SQL + PHOTOS_SQL + """ok as (select a.*, p.sha256 from actions a join photos p on p.id = a.photo_id where not p.missing and p.source = 'local'),
last as (select sha256, max_by(photo_id, {'t': ts, 'a': action_id}) as who, max_by(status, {'t': ts, 'a': action_id}) as st from ok group by sha256),
far as (select p.id, max_by(a.status, {'t': a.ts, 'a': a.action_id}) as st from actions a join photos p on p.id = a.photo_id and p.source = 'icloud' group by 1),"""


@register(_LOCAL_FOLD, "select p.id, case when p.source = 'icloud' then coalesce(f.st, p.status) when p.id = l.who then l.st when l.who is not null and not p.missing then 'rejected' else p.status end as status from photos p left join last l using (sha256) left join far f on f.id = p.id")
def decisions_applied(s, d):
    """C7."""
    p = views.photos(s, d)
    none = p.filter("source = 'icloud'").select("account", "remote_id", "status").limit(0)
    return decisions.apply_decisions(p, none, views.actions(s, d))[0].select("id", "status")


@register(PHOTOS_SQL + _EXPORT, "select path as relative_path, case when id % 3 = 0 then 'skip' else 'copy' end as action, case when id % 3 = 1 then regexp_replace(substr(path, 10), '(\\.[a-z]+)$', ' (1)\\1') else substr(path, 10) end as target from f where id in (select id from photos where status = 'selected')")
def incremental_export(s, d):
    """U7. Only what has just been selected."""
    changed = views.photos(s, d).filter("status = 'selected'").select(F.concat(F.lit("selected/"), paths.name_of("relative_path")).alias("relative_path"))
    return _export(s, d, changed)


@register(REMOTE_SQL + PHOTOS_SQL + _LISTED, f"select relative_path, case split_part(relative_path, '/', 1) when 'selected' then 'selected' when 'rejected' then 'rejected' else 'optional' end as status from listed union all select '@icloud/' || account || '/' || remote_id, case when (account, remote_id) in (select (account, remote_id) from decisions) then 'rejected' else 'optional' end from items")
def rebuilt_catalog(s, d):
    """R7. A catalog from listings and states alone."""
    p = views.photos(s, d)
    named, got = views.remote_state(s, d)
    return remote.rebuild_catalog(p.limit(0), _listing(p), remote.read_remote_listing(views.remote_listing(s, d)), got, named).select("relative_path", "status")
