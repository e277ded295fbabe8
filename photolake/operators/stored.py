"""The timeline as a stored order, so that a page, a photo's neighbours or a rank reads a few hundred rows.

A version of the catalog is written once: visible rows with their badges, by day
and within a day by slices of their rank, and small tables of counts with their
running sums. Look-ups find days in those and open the slices they need.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from photolake.operators.ranks import rank_within
from photolake.operators.timeline import PAGE, companion_paths
from photolake.session import stash

#: Rows of a day that are stored together.
SLICE = 10_000
#: The day of rows without a capture time, which come first.
NO_DAY = "0000-00-00"


def day_of(c: str | Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(NO_DAY))


def visible(photos: DataFrame) -> DataFrame:
    """T2, T9. The rows that timeline() shows, with dupe_count, is_live and download_pending; copies are counted once, for both."""
    hashed = F.coalesce("sha256", F.lit("")) != ""
    keep = F.min(F.struct((F.col("status") == "rejected").alias("rejected"), F.col("id")))
    present = photos.filter("not missing")
    copies = present.filter(hashed).groupBy("sha256").agg(keep.alias("_m"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("sha256", F.col("_m.id").alias("_keep"), "_n")
    rows = present.join(copies, "sha256", "left").filter("_keep is null or id = _keep").join(companion_paths(photos), "relative_path", "left_anti")
    pending = (F.col("source") == "icloud") & (F.col("status") == "selected")
    live = F.coalesce("live_photo_video_path", F.lit("")) != ""
    return rows.select(*photos.columns, F.coalesce("_n", F.lit(0)).cast("long").alias("dupe_count"), live.alias("is_live"), pending.alias("download_pending"))


def _with_sums(counts: DataFrame, by: list[str], name: str, latest_first: bool = False) -> DataFrame:
    """Counts by day with the sum of all days before; a row for each calendar day at most."""
    order = F.desc("day") if latest_first else F.asc("day")
    return counts.withColumn(name, F.sum("n").over(Window.partitionBy(*by).orderBy(order)) - F.col("n"))


def store_timeline(photos: DataFrame, base: str) -> str:
    """Writes the order of one version of the catalog below base, a fresh folder, and returns it."""
    rows = visible(photos).withColumn("day", day_of("captured_at"))
    placed = stash(rank_within(rows, ["day"], ["captured_at", "id"], "place").withColumn("slice", F.floor(F.col("place") / SLICE).cast("int")), "ordered")
    placed.drop("day", "slice").limit(0).write.parquet(f"{base}/columns")
    placed.hint("rebalance", "day", "slice").write.partitionBy("day", "slice").parquet(f"{base}/rows")
    _with_sums(placed.groupBy("day").agg(F.count(F.lit(1)).alias("n")), [], "before").coalesce(1).write.parquet(f"{base}/days")
    remote = photos.filter("source = 'icloud' and captured_at is not null").select("account", "captured_at", day_of("captured_at").alias("day"))
    remote.hint("rebalance", "day").sortWithinPartitions("account").write.partitionBy("day").parquet(f"{base}/remote")
    _with_sums(remote.groupBy("account", "day").agg(F.count(F.lit(1)).alias("n")), ["account"], "later", latest_first=True).write.parquet(f"{base}/accounts")
    return base


class Stored:
    """Look-ups in what store_timeline() wrote."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        kept = spark.read.parquet(f"{base}/columns").schema
        self.schema = StructType([*kept, StructField("day", StringType()), StructField("slice", IntegerType())])
        days = spark.read.parquet(f"{base}/days").orderBy("day").collect()  # a row for each day
        self.days = [r.day for r in days]
        self.before = [r.before for r in days]
        self.total = days[-1].before + days[-1].n if days else 0

    def between(self, begin: int, end: int) -> DataFrame:
        """Rows at the positions from begin on and before end, with their `pos`."""
        begin, end = max(begin, 0), min(end, self.total)
        if begin >= end:
            return self.spark.createDataFrame([], self.schema).withColumn("pos", F.lit(0).cast("long")).drop("day", "slice", "place")
        first, last = (bisect_right(self.before, x) - 1 for x in (begin, end - 1))
        wanted, paths = F.lit(False), []
        for k in range(first, last + 1):
            a, z = max(begin - self.before[k], 0), end - self.before[k]
            z = min(z, (self.before[k + 1] if k + 1 < len(self.days) else self.total) - self.before[k])
            paths += [f"{self.base}/rows/day={self.days[k]}/slice={x}" for x in range(a // SLICE, (z - 1) // SLICE + 1)]
            wanted = wanted | ((F.col("day") == self.days[k]) & F.col("place").between(a, z - 1))
        rows = self.spark.read.schema(self.schema).option("basePath", f"{self.base}/rows").parquet(*paths).filter(wanted)
        offset = F.element_at(F.create_map(*(F.lit(x) for k in range(first, last + 1) for x in (self.days[k], self.before[k]))), F.col("day"))
        return rows.withColumn("pos", offset + F.col("place")).drop("day", "slice", "place")

    def page(self, number: object = 1, size: int = PAGE) -> DataFrame:
        """T4. The page's rows in order; a non-number is page 1, a number out of range the last page."""
        try:
            wanted = int(number)
        except (TypeError, ValueError):
            wanted = 1
        last = max(1, -(-self.total // size))
        wanted = wanted if 1 <= wanted <= last else last
        return self.between((wanted - 1) * size, wanted * size).orderBy("pos")

    def position(self, photo_id: int, captured_at) -> int | None:
        """Place of a shown photo in the whole order."""
        day = self.spark.range(1).select(day_of(F.lit(captured_at).cast("timestamp"))).first()[0]
        if day not in self.days:
            return None
        k = self.days.index(day)
        rows = self.spark.read.schema(self.schema).option("basePath", f"{self.base}/rows").parquet(f"{self.base}/rows/day={day}")
        found = rows.filter(F.col("id") == photo_id).select("place").head()
        return None if found is None else self.before[k] + found.place

    def around(self, photo_id: int, captured_at, radius: int = 10) -> DataFrame:
        """T6, T7. The photo and those around it, with pos; its own neighbours are those one place away."""
        at = self.position(photo_id, captured_at)
        return self.between(0, 0) if at is None else self.between(at - radius, at + radius + 1).orderBy("pos")

    def date_rank(self, probes: DataFrame) -> DataFrame:
        """T12. account, at, rank (rows of the account captured later) for a few probes (account, at): sums of later days, and a count within the probe's own day."""
        asked = probes.select("account", "at", day_of("at").alias("day")).distinct()
        days = [r[0] for r in asked.select("day").distinct().collect()]
        rows = self.spark.read.schema("account string, captured_at timestamp, day string").parquet(f"{self.base}/remote").filter(F.col("day").isin(days))
        same = asked.join(rows, ["account", "day"]).filter("captured_at > at").groupBy("account", "at").agg(F.count(F.lit(1)).alias("_same"))
        sums = self.spark.read.parquet(f"{self.base}/accounts")
        later = asked.join(sums.select("account", F.col("day").alias("_d"), "n"), "account").filter("_d > day").groupBy("account", "at").agg(F.sum("n").alias("_later"))
        out = asked.join(same, ["account", "at"], "left").join(later, ["account", "at"], "left")
        return out.select("account", "at", (F.coalesce("_same", F.lit(0)) + F.coalesce("_later", F.lit(0))).cast("long").alias("rank"))
