"""Counts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from photolake.schemas import STATUSES


def counts_by_status(photos: DataFrame) -> DataFrame:
    """A5. Every status with its count, missing rows included."""
    every = photos.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = photos.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def provenance_matrix(photos: DataFrame) -> DataFrame:
    """A6. provenance ("(root)" for none), a count for each status, total; in order of the raw provenance."""
    each = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    rows = photos.groupBy("provenance").agg(*each, F.count(F.lit(1)).alias("total")).orderBy("provenance")
    return rows.withColumn("provenance", F.when(F.col("provenance") == "", "(root)").otherwise(F.col("provenance")))


def selected_bytes(photos: DataFrame) -> DataFrame:
    """A7."""
    return photos.filter("status = 'selected'").agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def totals(photos: DataFrame) -> DataFrame:
    """A8. total, missing."""
    return photos.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("missing")).alias("missing"))


def unresolved_pairs(pairs: DataFrame, photos: DataFrame) -> DataFrame:
    """A9. Unresolved pairs both of whose photos are present."""
    present = photos.filter("not missing").select("id")
    out = pairs.filter("not resolved").join(present.toDF("photo_a"), "photo_a", "left_semi")
    return out.join(present.toDF("photo_b"), "photo_b", "left_semi").select(*pairs.columns)


def account_overview(photos: DataFrame, states: DataFrame, downloaded: DataFrame) -> DataFrame:
    """A10. For each account with a state: items known, downloads pending, cursor."""
    waiting = photos.filter("source = 'icloud' and status = 'selected' and remote_id is not null").select("account", "remote_id")
    waiting = waiting.join(downloaded.select("account", "remote_id"), ["account", "remote_id"], "left_anti").groupBy("account").agg(F.count(F.lit(1)).alias("pending"))
    known = photos.filter("account <> ''").groupBy("account").agg(F.count(F.lit(1)).alias("items"))
    out = states.select("account", "cursor").join(known, "account", "left").join(waiting, "account", "left")
    return out.select("account", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("items", "pending")), "cursor")


def with_errors(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """A11. (rows without an error, rows with one and its text); one bad row never stops the rest."""
    marked = rows.withColumn("error", error)
    return marked.filter("error is null").drop("error"), marked.filter("error is not null")


def observed(rows: DataFrame, error: Column, name: str) -> tuple[DataFrame, Observation]:
    """A11. The rows with their error (null: fine), and what the job that writes them will count on its way, without a second pass."""
    seen = Observation(name)
    marked = rows.withColumn("error", error)
    return marked.observe(seen, F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count(F.lit(1)).alias("total")), seen


def observed_report(spark: SparkSession, steps: dict[str, Observation]) -> DataFrame:
    """A11. step, done, errors, total of jobs that have run."""
    return spark.createDataFrame([(name, *(int(seen.get[k]) for k in ("done", "errors", "total"))) for name, seen in steps.items()], REPORT)


REPORT = "step string, done long, errors long, total long"


class StreamReport(StreamingQueryListener):
    """A11 for streams: sums of done, errors and total over the batches of observed queries. Register it by spark.streams.addListener()."""

    def __init__(self) -> None:
        self.steps: dict[str, dict[str, int]] = {}
        self.batches: dict[str, set[int]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        for name, row in event.progress.observedMetrics.items():
            if event.progress.batchId not in self.batches.setdefault(name, set()):  # a batch may be told twice
                self.batches[name].add(event.progress.batchId)
                own = self.steps.setdefault(name, dict.fromkeys(("done", "errors", "total"), 0))
                for k in own:
                    own[k] += int(row[k] or 0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def report(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(name, *x.values()) for name, x in self.steps.items()], REPORT)


def observed_stream(rows: DataFrame, error: Column, name: str) -> DataFrame:
    """A11. The stream's rows with their error, counted for a StreamReport."""
    marked = rows.withColumn("error", error)
    return marked.observe(name, F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count(F.lit(1)).alias("total"))


def run_report(steps: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """A11. step, done, errors, total."""
    out = None
    for name, (ok, bad) in steps.items():
        one = ok.select(F.lit(1).alias("d"), F.lit(0).alias("e")).unionAll(bad.select(F.lit(0), F.lit(1)))
        one = one.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("done"), F.coalesce(F.sum("e"), F.lit(0)).alias("errors")).select(F.lit(name).alias("step"), "done", "errors", (F.col("done") + F.col("errors")).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out
