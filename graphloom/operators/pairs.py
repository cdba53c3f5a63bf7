"""Joins that make many more rows than they read: pairs of a key are dealt to tasks by how many there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import stored

#: Rows of a side of a block: a block makes the square of it at most, on average.
SIDE = 1024
#: Pairs, and rows read, that a task is meant for; tasks at most.
TASK_PAIRS, TASK_ROWS, MOST_TASKS = 8_000_000, 500_000, 8192


def dealt_join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """a.join(b, on), with its pairs spread over tasks.

    An equi-join puts all pairs of a key in one task, and small inputs in few tasks, however many pairs they make. Here a key's rows fall into groups of about
    SIDE on either side, and each group of one side meets each of the other in a block of its own, so every pair is met once. Rows are copied once for
    each group of the other side: as many as pairs / SIDE. The driver is told the number of pairs and rows.
    """
    sizes = a.groupBy(*on).agg(F.count("*").alias("_na")).join(b.groupBy(*on).agg(F.count("*").alias("_nb")), on)
    sizes = stored(sizes.select(*on, F.ceil(F.col("_na") / SIDE).alias("_ga"), F.ceil(F.col("_nb") / SIDE).alias("_gb"), (F.col("_na").cast("double") * F.col("_nb")).alias("_pairs"), (F.col("_na") * F.ceil(F.col("_nb") / SIDE) + F.col("_nb") * F.ceil(F.col("_na") / SIDE)).alias("_rows")), "sizes")
    total = sizes.agg(F.sum("_pairs").alias("pairs"), F.sum("_rows").alias("rows")).first()
    tasks = min(MOST_TASKS, int((total.pairs or 0) / TASK_PAIRS + (total.rows or 0) / TASK_ROWS) + 1)
    if tasks == 1:
        return a.join(b, on)
    block = [*on, "_i", "_j"]
    part = lambda df, own, other: df.join(sizes.select(*on, "_ga", "_gb"), on).withColumn(own[0], F.floor(F.rand(0) * F.col(own[1]))).withColumn(other[0], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other[1]) - 1))).drop("_ga", "_gb").repartition(tasks, *block)
    return part(a, ("_i", "_ga"), ("_j", "_gb")).join(part(b, ("_j", "_gb"), ("_i", "_ga")), block).drop("_i", "_j")


def joined_pairs(x: DataFrame, y: DataFrame) -> DataFrame:
    """Distinct pairs (a, c) of which a b exists with (a, b) in x and (b, c) in y.

    What has one b only makes no pair twice, so just the pairs of an a with several are compared with each other.
    """
    x, y = x.select("a", "b").distinct(), y.select("b", "c").distinct()
    counted = x.groupBy("a").agg(F.count("*").alias("_n"), F.min("b").alias("b"))
    once = dealt_join(counted.where("_n = 1").select("a", "b"), y, ["b"]).select("a", "c")
    several = counted.where("_n > 1").select("a")
    if several.isEmpty():
        return once
    return once.unionByName(dealt_join(x.join(several, "a", "left_semi"), y, ["b"]).select("a", "c").distinct())
