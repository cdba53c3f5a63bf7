"""Exact order statistics of many groups without a task that holds a group: values are ranged over partitions, and counts cumulated with offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.storage import stored


def cumulated(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, value, until, n: each distinct value, how many of the group's values are at most it, and how many there are. Nulls and NaN are left out."""
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(group, value).agg(F.count("*").alias("k"))
    ranged = stored(counts.repartitionByRange(group, value).withColumn("part", F.spark_partition_id()), "ranged")
    of_part = ranged.groupBy("part", group).agg(F.sum("k").alias("m"))  # a row for each group of each partition
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = of_part.select("part", group, F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy(group)).alias("n"))
    within = F.sum("k").over(Window.partitionBy("part", group).orderBy(value))
    return ranged.withColumn("within", within).join(offsets, ["part", group]).select(group, value, (F.col("before") + F.col("within")).alias("until"), "n")


def at_index(value: str, index: Column) -> Column:
    """Aggregate over cumulated rows of a group: the value at an index (from 0) of its sorted values."""
    return F.min(F.when(F.col("until") > index, F.col(value)))


def quantile(value: str, p: float) -> Column:
    """Aggregate over cumulated rows of a group: the quantile by linear interpolation at (n - 1) * p."""
    place = (F.col("n") - 1) * p
    low, high = at_index(value, F.floor(place)), at_index(value, F.ceil(place))
    share = F.max(place - F.floor(place))
    return low + (high - low) * share


def upper_median(value: str) -> Column:
    """Aggregate over cumulated rows of a group: the upper of the middle values."""
    return at_index(value, F.floor(F.col("n") / 2))
