"""Catalog-shaped views of the given tables, and the same views as SQL for the oracle.

The tables hold no photos; every column here follows from theirs by a fixed rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.schemas import PAIRS
from photolake.session import table, use_package, work_dir


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One photo an event."""
    use_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return photos_of_events(table(spark, sf_dir, "events"))


def photos_of_events(events: DataFrame) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.regexp_extract("props", r'"k": (\d+)', 1).cast("long"))
    i = F.col("event_id")
    remote = i % 13 == 0
    prov = F.when(F.col("user_id") % 7 == 0, "").otherwise(F.concat(F.lit("acct-"), (F.col("user_id") % 5).cast("string")))
    video = i % 2 == 1
    stem = F.concat(F.lit("IMG_"), F.floor(i / 2).cast("string"))
    path = F.concat(F.lit("d"), (F.floor(i / 2) % 10).cast("string"), F.lit("/"), stem, F.when(video, ".mov").otherwise(".jpg"))
    return e.select(
        i.alias("id"), path.alias("relative_path"),
        F.when(F.col("event_type") == "purchase", "selected").when(F.col("event_type") == "error", "rejected").otherwise("optional").alias("status"),
        F.when(i % 17 == 0, path).otherwise("").alias("original_path"), prov.alias("provenance"),
        F.round(F.col("value") * 100).cast("long").alias("file_size"), F.unix_micros("ts").cast("double").alias("file_mtime"),
        F.sha2(F.concat_ws("-", F.col("k").cast("string"), F.round("value").cast("long").cast("string")), 256).alias("sha256"),
        F.concat(F.substring(F.md5((F.col("k") % 4).cast("string")), 1, 13), F.lpad(F.lower(F.hex(i % 512)), 3, "0")).alias("phash"), F.col("ts").alias("captured_at"),
        F.when(i % 3 == 0, "exif").when(i % 3 == 1, "filename").otherwise("file_mtime").alias("captured_at_source"),
        F.when(video, "video").otherwise("image").alias("media_type"),
        F.when((i % 20 == 0) & ~video, F.concat(F.lit("d"), (F.floor(i / 2) % 10).cast("string"), F.lit("/"), stem, F.lit(".mov"))).alias("live_photo_video_path"),
        (i % 11 == 0).alias("missing"), F.when(F.col("user_id") % 3 == 0, F.col("ts")).alias("status_changed_at"), F.col("ts").alias("indexed_at"),
        F.when(remote, "icloud").otherwise("local").alias("source"), F.when(remote, prov).otherwise("").alias("account"),
        F.when(remote, F.concat(F.lit("r"), i.cast("string"))).alias("remote_id"), F.when(remote, F.concat(stem, F.lit(".HEIC"))).otherwise("").alias("remote_filename"),
        F.when(i % 29 == 0, (F.col("user_id") % 4)).alias("source_ref"),
    )


PHOTOS_SQL = r"""
photos as (select event_id as id,
  'd' || cast((event_id // 2) % 10 as varchar) || '/IMG_' || cast(event_id // 2 as varchar) || case when event_id % 2 = 1 then '.mov' else '.jpg' end as relative_path,
  case event_type when 'purchase' then 'selected' when 'error' then 'rejected' else 'optional' end as status,
  case when event_id % 17 = 0 then 'd' || cast((event_id // 2) % 10 as varchar) || '/IMG_' || cast(event_id // 2 as varchar) || case when event_id % 2 = 1 then '.mov' else '.jpg' end else '' end as original_path,
  case when user_id % 7 = 0 then '' else 'acct-' || cast(user_id % 5 as varchar) end as provenance,
  cast(round(value * 100) as bigint) as file_size, cast(epoch_us(ts) as double) as file_mtime,
  sha256(regexp_extract(props, '"k": (\d+)', 1) || '-' || cast(cast(round(value) as bigint) as varchar)) as sha256,
  substr(md5(cast(cast(regexp_extract(props, '"k": (\d+)', 1) as bigint) % 4 as varchar)), 1, 13) || lpad(lower(to_hex(event_id % 512)), 3, '0') as phash,
  ts as captured_at, case event_id % 3 when 0 then 'exif' when 1 then 'filename' else 'file_mtime' end as captured_at_source,
  case when event_id % 2 = 1 then 'video' else 'image' end as media_type,
  case when event_id % 20 = 0 then 'd' || cast((event_id // 2) % 10 as varchar) || '/IMG_' || cast(event_id // 2 as varchar) || '.mov' end as live_photo_video_path,
  event_id % 11 = 0 as missing, case when user_id % 3 = 0 then ts end as status_changed_at,
  case when event_id % 13 = 0 then 'icloud' else 'local' end as source,
  case when event_id % 13 <> 0 then '' when user_id % 7 = 0 then '' else 'acct-' || cast(user_id % 5 as varchar) end as account,
  case when event_id % 13 = 0 then 'r' || cast(event_id as varchar) end as remote_id,
  case when event_id % 13 = 0 then 'IMG_' || cast(event_id // 2 as varchar) || '.HEIC' else '' end as remote_filename,
  case when event_id % 29 = 0 then user_id % 4 end as source_ref
 from events),
hashed as (select * from photos where not missing and sha256 <> ''),
reps as (select sha256, coalesce(min(id) filter (status <> 'rejected'), min(id)) as keep, count(*) as n from hashed group by sha256),
redundant as (select h.id, h.sha256 from hashed h join reps r using (sha256) where h.id <> r.keep),
companions as (select distinct live_photo_video_path as p from photos where not missing and coalesce(live_photo_video_path, '') <> ''),
shown as (select * from photos where not missing and id not in (select id from redundant) and relative_path not in (select p from companions)),
"""


def stored(spark: SparkSession, sf_dir: str, fresh: bool = False):
    """The timeline's stored order for these tables, written once a session as long as the event table stays as it is, or anew."""
    from photolake.operators.stored import Stored, store_timeline

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    key = (sf_dir, at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime())
    sc = spark.sparkContext
    have = getattr(sc, "_photolake_stored", None)
    if fresh or not have or have[0] != key:
        sc._photolake_stored = have = (key, store_timeline(photos(spark, sf_dir), work_dir(spark, "timeline")))
    return Stored(spark, have[1])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a document; names carry dates of several shapes, good and bad."""
    use_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    y, mo, da, h, mi, s = 1985 + i % 120, 1 + i % 13, 1 + i % 31, i % 24, i % 60, i % 61
    compact = F.concat(F.lit("IMG_"), y.cast("string"), two(mo), two(da), F.lit("_"), two(h), two(mi), two(s))
    dashed = F.concat(y.cast("string"), F.lit("-"), two(mo), F.lit("-"), two(da), F.lit(" "), two(h), F.lit("."), two(mi), F.lit("."), two(s))
    name = F.when(i % 3 == 0, compact).when(i % 3 == 1, dashed).otherwise(F.concat(F.lit("plain"), i.cast("string")))
    top = F.when(i % 6 == 0, "selected/").when(i % 6 == 1, "rejected/").otherwise("")
    ext = F.when(i % 5 == 0, ".HEIC").when(i % 5 == 1, ".mov").when(i % 5 == 2, ".txt").otherwise(".jpg")
    hidden = F.when(i % 10 == 9, ".").otherwise("")
    middle = F.when(i % 4 == 3, "").otherwise(F.concat("source", F.lit("/"), "lang", F.lit("/")))
    tag = F.concat(y.cast("string"), F.lit(":"), two(mo), F.lit(":"), two(da), F.lit(" "), two(h), F.lit(":"), two(mi), F.lit(":"), two(s))
    return d.select(
        i, F.concat(top, middle, hidden, name, ext).alias("relative_path"), F.col("n_chars").alias("file_size"), (1_700_000_000 + i).cast("double").alias("file_mtime"), F.col("text").cast("binary").alias("content"),
        F.when(i % 4 == 0, "").when(i % 4 == 1, tag).alias("exif_datetime_original"), F.when(i % 8 < 6, tag).alias("exif_datetime"),
        F.when(i % 9 == 0, "").when(i % 9 == 1, "junk").alias("raw_dto"), F.when(i % 7 == 0, tag).alias("raw_cd"), F.lit(None).cast("string").alias("raw_mcd"),
    )


FILES_SQL = r"""
parts as (select *, 1985 + doc_id % 120 as y, 1 + doc_id % 13 as mo, 1 + doc_id % 31 as da, doc_id % 24 as h, doc_id % 60 as mi, doc_id % 61 as s from documents),
named as (select *, lpad(cast(mo as varchar), 2, '0') as mo2, lpad(cast(da as varchar), 2, '0') as da2, lpad(cast(h as varchar), 2, '0') as h2, lpad(cast(mi as varchar), 2, '0') as mi2, lpad(cast(s as varchar), 2, '0') as s2 from parts),
files as (select doc_id, n_chars as file_size, cast(1700000000 + doc_id as double) as file_mtime, text,
  case doc_id % 6 when 0 then 'selected/' when 1 then 'rejected/' else '' end || case when doc_id % 4 = 3 then '' else source || '/' || lang || '/' end
  || case when doc_id % 10 = 9 then '.' else '' end
  || case doc_id % 3 when 0 then 'IMG_' || y || mo2 || da2 || '_' || h2 || mi2 || s2 when 1 then y || '-' || mo2 || '-' || da2 || ' ' || h2 || '.' || mi2 || '.' || s2 else 'plain' || doc_id end
  || case doc_id % 5 when 0 then '.HEIC' when 1 then '.mov' when 2 then '.txt' else '.jpg' end as relative_path,
  case doc_id % 4 when 0 then '' when 1 then y || ':' || mo2 || ':' || da2 || ' ' || h2 || ':' || mi2 || ':' || s2 end as exif_datetime_original,
  case when doc_id % 8 < 6 then y || ':' || mo2 || ':' || da2 || ' ' || h2 || ':' || mi2 || ':' || s2 end as exif_datetime,
  case doc_id % 9 when 0 then '' when 1 then 'junk' end as raw_dto,
  case when doc_id % 7 = 0 then y || ':' || mo2 || ':' || da2 || ' ' || h2 || ':' || mi2 || ':' || s2 end as raw_cd
 from named),
named_files as (select *, regexp_extract(relative_path, '[^/]*$') as name from files),
"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One action an order, on a photo chosen by its number."""
    return actions_of_orders(table(spark, sf_dir, "orders"))


def actions_of_orders(o: DataFrame) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "selected").when(F.col("o_orderstatus") == "O", "rejected").otherwise("optional")
    return o.select(F.col("o_orderkey").alias("action_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), (F.col("o_custkey") * 7 % 10007).alias("photo_id"), status.alias("status"))


ACTIONS_SQL = """
actions as (select o_orderkey as action_id, o_orderdate as ts, o_custkey * 7 % 10007 as photo_id, case o_orderstatus when 'F' then 'selected' when 'O' then 'rejected' else 'optional' end as status from orders),
"""


def remote_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items of accounts named after customers; every third item is listed twice."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return listing_of_orders(table(spark, sf_dir, "orders"))


def listing_of_orders(orders: DataFrame) -> DataFrame:
    o = orders.withColumn("again", F.explode(F.sequence(F.lit(0), F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0))))
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("C "), (F.col("o_custkey") % 50).cast("string"), F.lit("@X.org")).alias("account"), (k * 2 + F.col("again")).alias("position"), F.concat(F.lit("r"), k.cast("string")).alias("remote_id"),
        F.when(k % 5 > 0, F.concat(F.lit("IMG_"), k.cast("string"), F.lit(".HEIC"))).alias("filename"), F.col("o_orderdate").cast("timestamp").alias("captured_at"),
        F.when(k % 4 > 0, F.round("o_totalprice").cast("long") + F.col("again")).alias("size"), F.when(k % 6 == 0, "movie").otherwise("image").alias("media_type"), (k % 7 == 0).alias("is_live"),
    )


def remote_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(decisions, downloaded) of those accounts."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    key = [F.concat(F.lit("C "), (F.col("o_custkey") % 50).cast("string"), F.lit("@X.org")).alias("account"), F.concat(F.lit("r"), k.cast("string")).alias("remote_id")]
    return o.filter(k % 8 == 0).select(*key, F.lit("rejected").alias("status")), o.filter(k % 10 == 0).select(*key, F.concat(F.lit("selected/r"), k.cast("string"), F.lit(".jpg")).alias("relative_path"))


REMOTE_SQL = """
keyed as (select *, 'C ' || cast(o_custkey % 50 as varchar) || '@X.org' as account, 'r' || cast(o_orderkey as varchar) as remote_id from orders),
decisions as (select account, remote_id, 'rejected' as status from keyed where o_orderkey % 8 = 0),
downloaded as (select account, remote_id from keyed where o_orderkey % 10 = 0),
items as (select account, remote_id, case when o_orderkey % 5 > 0 then 'IMG_' || cast(o_orderkey as varchar) || '.HEIC' else '' end as filename, o_orderdate as captured_at,
  case when o_orderkey % 4 > 0 then cast(round(o_totalprice) as bigint) else 0 end as size, case when o_orderkey % 6 = 0 then 'video' else 'image' end as media_type
  from keyed where (account, remote_id) not in (select (account, remote_id) from downloaded)),
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring photo numbers, every third resolved."""
    p = photos(spark, sf_dir).filter("id % 2 = 0").select(F.col("id").alias("photo_a"), (F.col("id") + 1).alias("photo_b"), (F.col("id") % 9).cast("short").alias("hamming_distance"), (F.col("id") % 3 == 0).alias("resolved"))
    return spark.createDataFrame([], PAIRS).unionByName(p)


PAIRS_SQL = "pairs as (select id as photo_a, id + 1 as photo_b, cast(id % 9 as smallint) as hamming_distance, id % 3 = 0 as resolved from photos where id % 2 = 0),"


def tree(spark: SparkSession, sf_dir: str) -> str:
    """Writes each document as a file, named as in files() under a folder of its own number, and returns the root."""
    root = work_dir(spark, "tree")
    local = root.removeprefix("file://").removeprefix("file:")

    def write(batches):
        import os

        for b in batches:
            for i, path, content in zip(b.doc_id, b.relative_path, b.content, strict=True):
                at = f"{local}/d{i % 20}/{i}/{path}"
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "wb") as f:
                    f.write(content or b"")
            yield b[["doc_id"]]

    files(spark, sf_dir).select("doc_id", "relative_path", "content").mapInPandas(write, "doc_id long").write.format("noop").mode("overwrite").save()
    return root
