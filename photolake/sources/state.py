"""Sidecar state as JSON documents with maps."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.operators.ranks import rank_within

_ACCOUNT = "account string, cursor string, decisions map<string,string>, downloaded map<string,string>, _corrupt string"
_SOURCE = "name string, decisions map<string,string>, _corrupt string"


POINTER = "CURRENT"
#: Entries of a document; an account or source with more is written as several documents of the same name.
MOST_ENTRIES = 100_000


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, base: str) -> str:
    """The folder that the pointer of `base` names, else base itself."""
    at, fs = _fs(spark, f"{base}/{POINTER}")
    if not fs.exists(at):
        return base
    return f"{base}/{spark.read.text(at.toString()).first()[0]}"


def switch(spark: SparkSession, base: str, version: str) -> None:
    """Makes a version folder the one that counts: the pointer is written aside and renamed over the old one, in one step."""
    aside, fs = _fs(spark, f"{base}/.{POINTER}-{version}")
    out = fs.create(aside, True)
    out.writeBytes(version)
    out.close()
    jvm = spark._jvm
    over = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = over
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(aside, jvm.org.apache.hadoop.fs.Path(f"{base}/{POINTER}"), options)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of all .json files below a path with their file: one a line, or, in files with lines that are no object, over several lines.

    Large files are read by lines, many tasks a file. Those with other lines
    are read as a whole and cut where a brace, a line end and a brace follow one
    another, which no text of an object can hold. Their names are known to the
    driver, which has listed them anyway. A missing path counts as empty.
    """
    path = current(spark, path)
    at, fs = _fs(spark, path)
    names = [c.split()[0] for c in re.split(r", (?=\w+ )", schema) if not c.startswith("_corrupt")]

    def parsed(rows: DataFrame) -> DataFrame:
        each = rows.withColumn("_x", F.from_json("_one", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
        sound = F.col("_x._corrupt").isNull() & F.col("_one").rlike(r"(?s)^\s*\{.*\}\s*$")
        return each.select("_file", *(F.when(sound, F.col(f"_x.{c}")).alias(c) for c in names), F.when(~sound, F.col("_one")).alias("_corrupt"))

    if not fs.exists(at):
        return parsed(spark.createDataFrame([], "_file string, _one string"))
    find = {"pathGlobFilter": "*.json", "recursiveFileLookup": True}
    named = F.col("_metadata.file_path").alias("_file")
    lines = parsed(spark.read.text(path, **find).select(named, F.col("value").alias("_one")).filter(r"_one rlike '\\S'"))
    broken = [r[0] for r in lines.filter("_corrupt is not null").select("_file").distinct().collect()]
    if not broken:
        return lines
    whole = spark.read.text(broken, wholetext=True).select(named, F.explode(F.split("value", r"(?<=\})\s*\n\s*(?=\{)")).alias("_one"))
    return lines.filter(~F.col("_file").isin(broken)).unionByName(parsed(whole))


def read_account_states(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """S3. (states, decisions, downloaded, quarantined) from the documents of accounts; a corrupt one or one that isn't an object is set aside.

    An account's documents are put together; its cursor is the latest.
    """
    docs = _read(spark, path, _ACCOUNT)
    bad = F.col("_corrupt").isNotNull() | F.col("account").isNull()
    good = docs.filter(~bad)
    states = good.groupBy("account").agg(F.max(F.expr("try_to_timestamp(cursor)")).alias("cursor"))
    decisions = good.select("account", F.explode("decisions").alias("remote_id", "status"))
    downloaded = good.select("account", F.explode("downloaded").alias("remote_id", "relative_path"))
    return states, decisions, downloaded, docs.filter(bad).select("_file", "_corrupt")


def read_source_states(spark: SparkSession, path: str, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S5. (decisions, quarantined) from one document for each registered source, named in it or else by its file, `{name}.json`."""
    docs = _read(spark, path, _SOURCE).withColumn("name", F.coalesce("name", F.regexp_extract("_file", r"([^/]+)\.json$", 1)))
    bad = F.col("_corrupt").isNotNull()
    named = docs.filter(~bad).join(sources.select(F.col("id").alias("source_id"), "name"), "name")
    return named.select("source_id", F.explode("decisions").alias("relative_path", "status")), docs.filter(bad).select("_file", "_corrupt")


def _split(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """Rows with the number of the document they go to: `most` a document, in order of the key."""
    return rank_within(rows, [by], [key], "_rank").withColumn("_doc", F.floor(F.col("_rank") / most)).drop("_rank")


def _maps(rows: DataFrame, by: str, key: str, value: str, name: str) -> DataFrame:
    return rows.groupBy(by, "_doc").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias(name))


def account_documents(states: DataFrame, decisions: DataFrame, downloaded: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """S6. One document an account, or several where it has more than `most` entries; decisions of status "optional" are left out."""
    d = _maps(_split(decisions.filter("status <> 'optional'"), "account", "remote_id", most), "account", "remote_id", "status", "decisions")
    w = _maps(_split(downloaded, "account", "remote_id", most), "account", "remote_id", "relative_path", "downloaded")
    every = states.select("account", "cursor", F.lit(0).cast("long").alias("_doc")).join(d, ["account", "_doc"], "full_outer").join(w, ["account", "_doc"], "full_outer")
    empty = F.create_map().cast("map<string,string>")
    return every.select("account", F.date_format("cursor", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("cursor"), F.coalesce("decisions", empty).alias("decisions"), F.coalesce("downloaded", empty).alias("downloaded"), F.lit(1).alias("version"))


def source_documents(sources: DataFrame, decisions: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """S6. One document a source, or several where it has more than `most` entries; decisions of status "optional" are left out."""
    named = decisions.filter("status <> 'optional'").join(sources.select(F.col("id").alias("source_id"), "name"), "source_id")
    maps = _maps(_split(named, "name", "relative_path", most), "name", "relative_path", "status", "decisions")
    every = sources.select("name", F.lit(0).cast("long").alias("_doc")).join(maps, ["name", "_doc"], "full_outer")
    return every.select("name", F.coalesce("decisions", F.create_map().cast("map<string,string>")).alias("decisions"), F.lit(1).alias("version"))


def write_states(documents: DataFrame, base: str, quarantined: DataFrame | None = None) -> str:
    """S6. Writes a fresh version folder, one document a line, then makes it the one that counts, and returns base.

    Until the pointer is switched, readers of base see the version before,
    whatever happens to the write. What couldn't be read (quarantined: _file,
    _corrupt) is kept beside the version. Older versions stay until
    drop_versions().
    """
    spark, version = documents.sparkSession, f"version-{uuid.uuid4().hex}"
    documents.write.json(f"{base}/{version}")
    if quarantined is not None:
        quarantined.write.parquet(f"{base}/quarantine/{version}")
    switch(spark, base, version)
    return base


def read_quarantine(spark: SparkSession, base: str) -> DataFrame:
    """What write_states() has kept, of all versions: _file, _corrupt, version."""
    at, fs = _fs(spark, f"{base}/quarantine")
    if not fs.exists(at):
        return spark.createDataFrame([], "_file string, _corrupt string, version string")
    rows = spark.read.schema("_file string, _corrupt string").option("recursiveFileLookup", True).parquet(at.toString())
    return rows.withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), "/(version-[0-9a-f]+)/", 1))


def drop_versions(spark: SparkSession, base: str) -> None:
    """Deletes the versions that don't count any more, once nothing reads them; the quarantine stays."""
    kept = current(spark, base).rpartition("/")[2]
    at, fs = _fs(spark, base)
    for x in fs.listStatus(at):
        name = x.getPath().getName()
        if name.startswith("version-") and name != kept:
            fs.delete(x.getPath(), True)


write_account_states = write_states
