"""Classes by tier, and what each tier allows: masters are few and strict, transactions many and lenient, catalogs may lie unused."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.tables import inline
from graphloom.storage import dealt

#: Of each tier, the share of dangling edges allowed, the percentage of declared properties filled, and the share of unreferenced instances allowed.
TIERS = {
    "master": (0.01, 80.0, 0.50),
    "catalog": (0.01, 80.0, 0.85),
    "transaction": (0.05, 50.0, 0.60),
    "inferred": (0.10, 30.0, 0.70),
}
#: A master has so many instances at most; and name ends of classes that are transactions even with few.
MASTER_MOST = 500
TRANSACTION_ENDS = (
    "History", "Plan", "Transaction", "Map", "Mapping", "Log", "Record", "Order", "Result", "Event", "Events",
)


def _types(t: DataFrame) -> DataFrame:
    """(s, c), each once. The rows are counted first and dealt by subject, as nearly all differ: a task before the shuffle keeps none, one after it a bounded number."""
    types = t.where("p = 'type'").select("s", F.col("o").alias("c"))
    return dealt(types, ["s"], types.count()).distinct()


def class_tiers(t: DataFrame, declared: DataFrame, catalog: list[str] | None = None, most: int = MASTER_MOST) -> DataFrame:
    """c, n, tier of declared classes (c) and of those with instances: catalog by name, inferred without instances, transaction beyond most or by its name's end, else master."""
    counted = _types(t).groupBy("c").agg(F.count("*").alias("n"))
    all_ = declared.select("c").distinct().join(counted, "c", "full").select("c", F.coalesce("n", F.lit(0)).alias("n"))
    by_name = reduce(Column.__or__, [F.col("c").endswith(e) for e in TRANSACTION_ENDS])
    tier = F.when(F.col("c").isin(catalog or []), "catalog").when(F.col("n") == 0, "inferred").when((F.col("n") > most) | by_name, "transaction")
    return all_.select("c", "n", tier.otherwise("master").alias("tier"))


def tier_report(t: DataFrame, tiers: DataFrame, domain: DataFrame, range_: DataFrame) -> DataFrame:
    """c, tier, metric, value, allowed, passed of each class with instances, to six places.

    orphan: the share of instances that no link leads to; a class that is no property's range passes, as nothing is meant to point to it.
    dangling: the share of links from its instances whose end has no type. coverage: the percentage of pairs of an instance and a property declared for its
    class (domain p, c) that have a value; classes without such properties are left out. Links and pairs are counted by instance before they meet.
    """
    types = _types(t)
    links = t.where("o_kind = 'iri' and p <> 'type'")
    met = links.select(F.col("o").alias("s")).distinct().withColumn("_met", F.lit(1))
    orphans = types.join(met, "s", "left").groupBy("c").agg((F.count_if(F.col("_met").isNull()) / F.count("*")).alias("value"))
    targets = range_.select("c").distinct().withColumn("_target", F.lit(True))
    orphans = orphans.join(targets, "c", "left").select("c", F.lit("orphan").alias("metric"), "value", F.col("_target").isNull().alias("exempt"))
    typed = types.select(F.col("s").alias("o")).distinct().withColumn("_typed", F.lit(1))
    ends = links.select("s", "o").join(typed, "o", "left").groupBy("s").agg(F.count("*").alias("_n"), F.count_if(F.col("_typed").isNull()).alias("_bad"))
    dangling = ends.join(types, "s").groupBy("c").agg((F.sum("_bad") / F.sum("_n")).alias("value"))
    dangling = dangling.select("c", F.lit("dangling").alias("metric"), "value", F.lit(False).alias("exempt"))
    due = domain.select("p", "c").distinct()
    filled = t.where("p <> 'type'").select("s", "p").distinct().join(types, "s").join(due, ["p", "c"]).groupBy("c").agg(F.count("*").alias("_k"))
    pairs = types.groupBy("c").agg(F.count("*").alias("_n")).join(due.groupBy("c").agg(F.count("*").alias("_d")), "c")
    covered = pairs.join(filled, "c", "left").select("c", F.lit("coverage").alias("metric"), (F.coalesce("_k", F.lit(0)) * 100.0 / (F.col("_n") * F.col("_d"))).alias("value"), F.lit(False).alias("exempt"))
    allowed = inline(t.sparkSession, [(k, m, float(x)) for k, own in TIERS.items() for m, x in zip(("dangling", "coverage", "orphan"), own, strict=True)], "tier string, metric string, allowed double")
    rows = reduce(DataFrame.unionByName, [orphans, dangling, covered]).join(tiers.select("c", "tier"), "c").join(allowed, ["tier", "metric"])
    within = F.when(F.col("metric") == "coverage", F.col("value") >= F.col("allowed")).otherwise(F.col("value") <= F.col("allowed"))
    return rows.select("c", "tier", "metric", F.round("value", 6).alias("value"), "allowed", (F.col("exempt") | within).alias("passed"))
