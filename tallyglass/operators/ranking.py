"""Places of rows within groups, where a group may be larger than a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise


def rank_within(rows: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """rows with their place (from 1) within keys by order.

    Rows are range-partitioned by keys and order, so a large group spreads over neighbouring partitions; each partition
    numbers its own rows, and adds how many rows of the group lie in partitions before it. These counts are one row for
    each partition and group in it, but only groups that begin in an earlier partition need one.
    """
    dealt = rows.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")  # so that the bounds, which are sampled, are drawn once
    counts = dealt.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    split = counts.groupBy(*keys).agg(F.count("*").alias("_parts")).where("_parts > 1").drop("_parts")
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    spread = counts.join(split, keys, "left_semi").withColumn("_before", before).drop("_n")
    local = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order))
    out = dealt.withColumn("_local", local).join(spread, [*keys, "_p"], "left")
    return out.withColumn(name, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_p", "_local", "_before")
