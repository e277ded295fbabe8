"""Plain Parquet tables that streams read and write in part.

A table is partitioned by a hash of its key, so that a batch reads the few
partitions its own keys fall into, however large the table is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.session import remove

#: Default number of hash partitions; choose it so that a partition suits one task.
BUCKETS = 64


def bucket_of(*key: str | Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def partition_names(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's partition folders."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at) if "=" in x.getPath().getName()) if fs.exists(at) else []


def values(rows: DataFrame, column: Column) -> list:
    """Distinct values, of which a batch has few: buckets or days."""
    return [r[0] for r in rows.select(column).distinct().collect()]


def write_parts(df: DataFrame, path: str, *by: str) -> None:
    """A fresh table; each partition is written by one task, or by more where Spark splits a large one."""
    df.hint("rebalance", *by).write.partitionBy(*by).parquet(path)


def read_parts(spark: SparkSession, path: str, like: DataFrame, by: str, wanted: list) -> DataFrame:
    """Rows of the wanted partitions alone, with the columns of `like` and `by`."""
    rows = spark.read.schema(like.schema).option("basePath", path).parquet(path)
    return rows.filter(F.col(by).isin(wanted)) if wanted else rows.filter("false")


def replace_parts(spark: SparkSession, path: str, batch: int, rows: Callable[[], DataFrame], *by: str, turn: int = 0, whole: bool = False, placed: bool = False) -> DataFrame:
    """Puts rows() in place of the partitions they belong to and returns them as written.

    They are first written aside under the batch's number and turn: if the
    batch is run again, after a crash at whatever point, what is there is put in
    place once more, and rows() isn't asked about a table that is half changed.
    whole: rows() are all rows of the table, so that partitions without any go.
    placed: most of rows() come from the table as they are and lie by partition
    still, so they are put in place without being dealt out anew.
    """
    aside = f"{path}-written"
    own = f"{aside}/batch={batch:012d}-{turn:04d}"
    if not exists(spark, f"{own}/_SUCCESS"):
        rows().write.mode("overwrite").parquet(own)
    done = spark.read.parquet(own)
    (done if placed else done.hint("rebalance", *by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    kept = {f"{by[0]}={x}" for x in values(done, F.col(by[0]))} if whole else set()
    for name in partition_names(spark, path) if whole else []:
        if name not in kept:
            remove(spark, f"{path}/{name}")
    for name in partition_names(spark, aside):
        if name < own.rpartition("/")[2]:
            remove(spark, f"{aside}/{name}")
    return done
