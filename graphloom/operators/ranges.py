"""Joins of points with the intervals that hold them, as equi-joins on bins whose width follows each interval's length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.pairs import dealt_join

#: Bin widths are powers of two whose exponents differ by this, so that points meet few widths.
LEVEL_STEP = 3
#: The least width is two to this power; shorter intervals use it.
LEAST_LEVEL = -30


def _number(column: str) -> Column:
    return F.col(column).cast("double")


def _seconds(df: DataFrame, column: str) -> Column:
    """The column as a number; times as seconds with their fraction."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1e6)
    return F.unix_date(column).cast("double") if kind == "date" else _number(column)


def range_join(points: DataFrame, intervals: DataFrame, on: list[str], point: str, low: str, high: str, closed: str = "both", how: str = "inner") -> DataFrame:
    """points with the intervals (equal in the columns on) that hold their point, once for each; how is inner, left, left_semi or left_anti.

    closed tells the ends that belong to an interval: both, left, right or neither. A null low or high is no bound on that side; one whose low
    is above its high holds nothing, and a null or NaN point is in no interval. Points and bounds are numbers, dates or times. Names but
    those of on must differ on both sides.

    Each interval falls in a class of lengths, whose bins are at least as wide as it is, so it touches two bins at most, however long it is.
    A point has one bin for each class of lengths that occurs. The join is on bins, then on the exact bounds: no pair is met twice, and none
    outside neighbouring bins. The pairs of a hot bin are spread over tasks. The driver is told the classes of lengths (some tens at most) and the points' extent.
    """
    if closed not in ("both", "left", "right", "neither") or how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"closed {closed}, how {how}")
    if (set(points.columns) & set(intervals.columns)) - set(on):
        raise ValueError(f"both sides have {sorted((set(points.columns) & set(intervals.columns)) - set(on))}")
    own = points.withColumn("_at", _seconds(points, point))
    extent = own.where(~F.isnan("_at")).agg(F.min("_at").alias("low"), F.max("_at").alias("high")).first()
    first, last = (0.0, 0.0) if extent.low is None else (extent.low, extent.high)
    bounded = intervals.withColumns({"_low": _seconds(intervals, low), "_high": _seconds(intervals, high)})
    clipped = bounded.withColumns({"_from": F.greatest(F.coalesce("_low", F.lit(first)), F.lit(first)), "_to": F.least(F.coalesce("_high", F.lit(last)), F.lit(last))}).where("_from <= _to")
    exponent = F.ceil(F.log2(F.greatest(F.col("_to") - F.col("_from"), F.lit(2.0**LEAST_LEVEL))))
    level = F.ceil((exponent - LEAST_LEVEL) / LEVEL_STEP).cast("int")
    placed = clipped.withColumn("_level", level)
    levels = sorted(r[0] for r in placed.select("_level").distinct().collect())  # two thousand octaves of a double by three at most
    width = F.pow(F.lit(2.0), F.col("_level") * LEVEL_STEP + LEAST_LEVEL)
    bins = lambda x: F.floor(F.col(x) / width)
    right = placed.withColumn("_bin", F.explode(F.array_distinct(F.array(bins("_from"), bins("_to")))))
    left = own.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_bin", bins("_at"))
    above = F.col("_at") >= F.col("_low") if closed in ("both", "left") else F.col("_at") > F.col("_low")
    below = F.col("_at") <= F.col("_high") if closed in ("both", "right") else F.col("_at") < F.col("_high")
    within = F.coalesce(above, F.col("_low").isNull()) & F.coalesce(below, F.col("_high").isNull()) & ~F.isnan("_at")
    met = dealt_join(left, right, [*on, "_level", "_bin"]).where(within)
    rest = [c for c in intervals.columns if c not in on]
    inner = met.select(*points.columns, *rest)
    if how == "inner":
        return inner
    held = inner.select(*points.columns).distinct()
    same = reduce(lambda x, y: x & y, [F.col(f"p.{c}").eqNullSafe(F.col(f"h.{c}")) for c in points.columns])
    missing = points.alias("p").join(held.alias("h"), same, "left_semi" if how == "left_semi" else "left_anti")
    if how == "left":
        return inner.unionByName(missing.select("*", *[F.lit(None).cast(intervals.schema[c].dataType).alias(c) for c in rest]))
    return missing
