"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photolake.session import stash


def rank_within(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds each row's rank in its group, from 0.

    Rows are sorted over range partitions, so that a large group is spread over
    several: a rank is that within the partition plus the group's rows before it.
    Only a partition's first and last group can go on in another, so no others
    are counted.
    """
    placed = stash(rows.repartitionByRange(*group, *order).withColumn("_rank_part", F.spark_partition_id()), "placed")
    own = F.row_number().over(Window.partitionBy("_rank_part", *group).orderBy(*order)).cast("long") - 1
    keys = F.struct(*group)
    ends = placed.groupBy("_rank_part").agg(F.min(keys).alias("_lo"), F.max(keys).alias("_hi")).select(F.explode(F.array("_lo", "_hi")).alias("_end"))
    ends = ends.select(*(F.col("_end").getField(c).alias(f"_end_{i}") for i, c in enumerate(group))).distinct()
    there = [F.col(c).eqNullSafe(F.col(f"_end_{i}")) for i, c in enumerate(group)]
    sizes = placed.join(F.broadcast(ends), there, "left_semi").groupBy("_rank_part", *group).count()
    before = (F.sum("count").over(Window.partitionBy(*group).orderBy("_rank_part")) - F.col("count")).alias("_rank_before")
    before = sizes.select("_rank_part", *group, before).filter("_rank_before > 0")  # at most one group a partition
    named = F.broadcast(before.select("_rank_before", *(F.col(c).alias(f"_rank_{i}") for i, c in enumerate(["_rank_part", *group]))))
    same = [F.col(c).eqNullSafe(F.col(f"_rank_{i}")) for i, c in enumerate(["_rank_part", *group])]
    joined = placed.withColumn(name, own).join(named, same, "left")
    return joined.select(*rows.columns, (F.col(name) + F.coalesce("_rank_before", F.lit(0))).alias(name))


def running_sum(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows before each, in an order; summed within range partitions, plus the sums of those before."""
    placed = stash(rows.repartitionByRange(*order).withColumn("_sum_part", F.spark_partition_id()), "placed")
    own = F.sum(value).over(Window.partitionBy("_sum_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    sizes = placed.groupBy("_sum_part").agg(F.sum(value).alias("_sum"))  # a row for each partition
    before = sizes.select("_sum_part", (F.sum("_sum").over(Window.orderBy("_sum_part")) - F.col("_sum")).alias("_sum_before"))
    return placed.withColumn(name, own).join(F.broadcast(before), "_sum_part").select(*rows.columns, (F.col(name) + F.col("_sum_before")).alias(name))
