"""Declarative edge rules over tables: the pairing and lookup joins that make implicit relations explicit. All return (s, o)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.pairs import dealt_join
from graphloom.storage import stored


def indexed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its row number from 0 by order. Rows are ranged over partitions; each is numbered from where the ones before end."""
    ranged = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_within", within).join(before, "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")


def rotation(source: DataFrame, s: Column, s_order: list[str], target: DataFrame, o: Column, o_order: list[str], keep: Column | None = None) -> DataFrame:
    """Row i of the source pairs with row i mod N of the target; rows that keep skips still count in i. N is read once."""
    right = indexed(target.select("*", o.alias("_o")), o_order, "_j").select("_o", "_j")
    n = right.count()
    left = indexed(source, s_order, "_i")
    left = left if keep is None else left.where(keep)
    return left.select(s.alias("s"), (F.col("_i") % max(n, 1)).alias("_j")).join(right, "_j").select("s", F.col("_o").alias("o"))


def number_match(source: DataFrame, s: Column, number_of: Column, template: str) -> DataFrame:
    """The trailing number of a column, formatted into the target's name."""
    digits = F.regexp_extract(number_of, "([0-9]+)$", 1)
    return source.where(digits != "").select(s.alias("s"), F.format_string(template, digits.cast("long")).alias("o"))


def simple_join(source: DataFrame, s: Column, fk: str, prefix: str, keep: Column | None = None) -> DataFrame:
    """An edge for every filled foreign key, whether or not its row exists."""
    rows = source if keep is None else source.where(keep)
    return rows.where(F.col(fk).isNotNull()).select(s.alias("s"), F.concat(F.lit(prefix), F.col(fk).cast("string")).alias("o"))


def fk_lookup(source: DataFrame, s: Column, column: str, lookup: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Through a lookup table in which the first row of a key wins."""
    first = lookup.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").select(F.col(key).alias("_k"), F.col(value).alias("o"))
    return source.select(s.alias("s"), F.col(column).alias("_k")).join(first, "_k").select("s", "o")


def via_chain(upstream: DataFrame, then: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Upstream edges (s, o) carried one hop further by a table's key and value, first row of a key first."""
    return fk_lookup(upstream, F.col("s"), "o", then, key, value, order)


def bucket_join(left: DataFrame, s: Column, left_bucket: Column, right: DataFrame, o: Column, right_bucket: Column) -> DataFrame:
    """Every pair that shares a bucket; the pairs of a bucket are spread over tasks."""
    a, b = left.select(s.alias("s"), left_bucket.alias("_b")), right.select(o.alias("o"), right_bucket.alias("_b"))
    return dealt_join(a, b, ["_b"]).select("s", "o")


def with_synthetic_fk(source: DataFrame, column: str, s_order: list[str], target: DataFrame, pk: str, o_order: list[str]) -> DataFrame:
    """source with a column of target keys by rotation; unchanged if it has the column."""
    if column in source.columns:
        return source
    right = indexed(target.select(F.col(pk).alias(column)), [column], "_j")
    n = right.count()
    return indexed(source, s_order, "_i").withColumn("_j", F.col("_i") % max(n, 1)).join(right, "_j").drop("_i", "_j")
