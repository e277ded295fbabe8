"""Session defaults, table loading, lineage cuts and code shipping shared by all jobs."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The folder that holds the package.
ROOT = str(Path(__file__).resolve().parent.parent)


def get_session(app: str = "photolake", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that every job expects (UTC, AQE)."""
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PHOTOLAKE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_package(spark: SparkSession) -> None:
    """Let Python workers import this package: by path on one machine, else as a shipped archive."""
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        have = sc.environment.get("PYTHONPATH", "")
        if ROOT not in have.split(os.pathsep):
            sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    elif not getattr(sc, "_photolake_shipped", False):
        out = Path(tempfile.mkdtemp(prefix="photolake-")) / "photolake.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in Path(ROOT, "photolake").rglob("*.py"):
                z.write(p, p.relative_to(ROOT))
        sc.addPyFile(str(out))
        sc._photolake_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see; a temporary one only where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(spark.sparkContext, "_photolake_tmp", None) or tempfile.mkdtemp(prefix="photolake-")
        spark.sparkContext._photolake_tmp = found
    return found


def _stashed(spark: SparkSession) -> set[str]:
    """Paths of this session's stashes that are still there; what is left when Python ends goes then."""
    sc = spark.sparkContext
    if not hasattr(sc, "_photolake_stashed"):
        sc._photolake_stashed = set()

        def sweep() -> None:
            with contextlib.suppress(Exception):  # the session may be gone already
                for path in list(sc._photolake_stashed):
                    remove(spark, path)

        atexit.register(sweep)
    return sc._photolake_stashed


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _stashed(spark).discard(path)


def stash(df: DataFrame, name: str = "stash") -> DataFrame:
    """Write df once to the shared folder and read it back: later steps neither recompute it nor depend on one executor's disk."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _stashed(spark).add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._photolake_path = path
    return out


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder of the shared store that goes when Python ends, for what a lazily returned frame still reads."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _stashed(spark).add(path)
    return path


def drop_stash(*stashed: DataFrame) -> None:
    """Remove the files of stash() results that nothing will read any more, neither directly nor through a frame not written yet."""
    for df in stashed:
        remove(df.sparkSession, df._photolake_path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what stash() has written within it; for work whose result is written by then."""
    before = set(_stashed(spark))
    try:
        yield
    finally:
        for path in _stashed(spark) - before:
            remove(spark, path)
