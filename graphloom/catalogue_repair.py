"""Queries of shape repairs, with their oracles; they add to the first catalogue's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.catalogue_rules import DATATYPE, on_kept_graph
from graphloom.operators import shape_repair as sr
from graphloom.sources.tables import inline

#: Balances with white space or a missing word put in, one status an order, customers as payers.
SHAPES = [
    ("balance is decimal", "Supplier", "supplierBalance", "datatype", "decimal", None),
    ("has a balance", "Supplier", "supplierBalance", "min", "1", "0"),
    ("one status", "Order", "status", "max", "1", None),
    ("has a status", "Order", "status", "min", "1", "N"),
    ("status is text", "Order", "status", "datatype", "string", None),
    ("payer", "Order", "placedBy", "class", "Customer", None),
]
PLAIN = r"regexp_replace(regexp_replace(o, '(\.\d*?)0+$', '\1'), '\.$', '')"
STATES = ", st AS (SELECT s, list(DISTINCT o ORDER BY o) AS own FROM g WHERE p = 'status' GROUP BY s)"


def _repaired(t: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    given = t.withColumn("o_dt", F.expr(DATATYPE))
    spaced, missing = (F.col("p") == "supplierBalance") & F.col("s").endswith("3"), (F.col("p") == "supplierBalance") & F.col("s").endswith("7")
    given = given.withColumn("o", F.when(spaced, F.concat(F.lit(" "), "o")).when(missing, "n/a").otherwise(F.col("o")))
    given = given.withColumn("o_dt", F.when(spaced | missing, "string").otherwise(F.col("o_dt")))
    return sr.repaired(given, inline(t.sparkSession, SHAPES, "shape string, c string, p string, kind string, value string, fallback string"), kept=True)


@on_kept_graph(f"""{STATES}
SELECT 1 AS round, 'balance is decimal' AS shape, 'cast' AS action, s, p, ' ' || o AS o, {PLAIN} AS new, 'decimal' AS new_dt FROM g WHERE p = 'supplierBalance' AND s LIKE '%3'
UNION ALL SELECT 1, 'balance is decimal', 'drop', s, p, 'n/a', NULL, NULL FROM g WHERE p = 'supplierBalance' AND s LIKE '%7'
UNION ALL SELECT 2, 'has a balance', 'add', s, p, NULL, '0', 'decimal' FROM g WHERE p = 'supplierBalance' AND s LIKE '%7'
UNION ALL SELECT 1, 'one status', 'choose', s, 'status', unnest(own[2:]), NULL, NULL FROM st WHERE len(own) > 1
UNION ALL SELECT 1, 'has a status', 'add', node, 'status', NULL, 'N', 'string' FROM ty WHERE c = 'Order' AND node NOT IN (SELECT s FROM st)""")
def shape_repair_log(t: DataFrame, _: dict[str, DataFrame]) -> DataFrame:
    return _repaired(t)[1]


@on_kept_graph(" SELECT 'payer' AS shape, 'class' AS kind, s, p, o FROM e WHERE p = 'placedBy' AND o NOT IN (SELECT node FROM ty)")
def shape_repair_rest(t: DataFrame, _: dict[str, DataFrame]) -> DataFrame:
    return _repaired(t)[2]
