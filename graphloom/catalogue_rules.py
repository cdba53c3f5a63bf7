"""Queries of rules as data and of consistency, with their oracles; they add to the first catalogue's."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalogue import CHAIN, DOM, ENTAILED, G, ORACLES, QUERIES, RAN, SUB, Query, _values
from graphloom.operators import consistency as cs
from graphloom.operators import maintenance as mt
from graphloom.operators import reasoning as rs
from graphloom.operators import rule_engine as re_
from graphloom.operators import tiers as ti
from graphloom.plans import star_graph as sg
from graphloom.sources.tables import inline
from graphloom.storage import shared_folder


def on_kept_graph(sql: str):
    """Register a plan over the stored graph under the function's name; sql follows the common table expressions g, ty and e."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(sg.kept_graph(spark, sf_dir), sg.schema_rows(spark))
        ORACLES[f.__name__] = f"{G}{sql}"
        return f

    return add


# --- rules as data ------------------------------------------------------------------------------------------------------------------

#: The shapes of rule files: three different partners, two steps, a comparison with a looked-up literal; and recursion, negation, and rules over derived facts.
RULES = """
frequent: Customer(?c) ^ placedBy(?a, ?c) ^ placedBy(?b, ?c) ^ placedBy(?d, ?c) ^ DifferentFrom(?a, ?b) ^ DifferentFrom(?b, ?d) ^ DifferentFrom(?a, ?d) -> Frequent(?c)
chain: inNation(?c, ?n) ^ inRegion(?n, ?r) -> chainedTo(?c, ?r)
over: Supplier(?s) ^ supplierBalance(?s, ?v) ^ greaterThan(?v, 5000) ^ basedIn(?s, ?n) ^ nationName(?n, "FRANCE") -> Violation(?s)
within_1: inNation(?x, ?y) -> within(?x, ?y)
within_2: inRegion(?x, ?y) -> within(?x, ?y)
within_3: basedIn(?x, ?y) -> within(?x, ?y)
within_4: within(?x, ?y) ^ within(?y, ?z) -> within(?x, ?z)
idle: Customer(?c) ^ not placedBy(?o, ?c) -> Idle(?c)
quiet: Idle(?c) ^ within(?c, ?r) ^ Region(?r) ^ not Frequent(?c) -> quietIn(?c, ?r)
"""


@on_kept_graph(""", w AS (SELECT s, o FROM e WHERE p IN ('inNation', 'inRegion', 'basedIn') UNION SELECT w.s, x.o FROM w JOIN e x ON w.o = x.s AND x.p IN ('inNation', 'inRegion', 'basedIn')),
idle AS (SELECT node AS s FROM ty WHERE c = 'Customer' AND node NOT IN (SELECT o FROM e WHERE p = 'placedBy'))
SELECT o AS s, 'type' AS p, 'Frequent' AS o FROM e WHERE p = 'placedBy' AND o IN (SELECT node FROM ty WHERE c = 'Customer') GROUP BY e.o HAVING count(DISTINCT s) >= 3
UNION SELECT x.s, 'chainedTo', y.o FROM e x JOIN e y ON x.o = y.s WHERE x.p = 'inNation' AND y.p = 'inRegion'
UNION SELECT g.s, 'type', 'Violation' FROM g JOIN e b ON b.s = g.s AND b.p = 'basedIn' JOIN g n ON n.s = b.o AND n.p = 'nationName' AND n.o = 'FRANCE' WHERE g.p = 'supplierBalance' AND g.o_num > 5000
UNION SELECT s, 'within', o FROM w
UNION SELECT s, 'type', 'Idle' FROM idle
UNION SELECT s, 'quietIn', o FROM idle JOIN w USING (s) WHERE o LIKE 'Region%'""")
def rules_joint(t: DataFrame, _: dict[str, DataFrame]) -> DataFrame:
    rules = re_.rules_of(re_.rule_lines(t.sparkSession, RULES.split("\n")))
    return rs.delta(re_.run_rules(t, rules, kept=True), t).select("s", "p", "o")


@on_kept_graph(f"{ENTAILED} SELECT s, p, o FROM f")
def rules_owl(t: DataFrame, k: dict[str, DataFrame]) -> DataFrame:
    chain = inline(t.sparkSession, CHAIN, "p string, q string, r string")
    return re_.owl_closure(t, k | {"chain": chain}, kept=True).select("s", "p", "o")


@on_kept_graph(""", party AS (SELECT node FROM ty WHERE c IN ('Customer', 'Supplier')), place AS (SELECT s FROM e WHERE p IN ('inNation', 'basedIn')),
local_ AS (SELECT node FROM party JOIN place ON node = s), rich AS (SELECT DISTINCT s FROM g WHERE p IN ('balance', 'supplierBalance')),
both_ AS (SELECT node FROM local_ JOIN rich ON node = s)
SELECT node AS s, 'LocalParty' AS c FROM both_ UNION SELECT node, 'Actor' FROM both_ UNION SELECT node, 'Actor' FROM ty WHERE c = 'Order'""")
def rules_intersection(t: DataFrame, _: dict[str, DataFrame]) -> DataFrame:
    """A class that needs three others at once, of which two are derived, and a union over it; inside one fixpoint."""
    of = lambda rows, columns: inline(t.sparkSession, rows, columns)
    schema = {
        "subclass": of([("Customer", "Party"), ("Supplier", "Party")], "a string, b string"),
        "domain": of([("inNation", "Located"), ("basedIn", "Located"), ("balance", "Rich"), ("supplierBalance", "Rich")], "p string, c string"),
        "intersection": of([("LocalParty", "Party"), ("LocalParty", "Located"), ("LocalParty", "Rich")], "c string, m string"),
        "union": of([("Actor", "LocalParty"), ("Actor", "Order")], "c string, m string"),
    }
    found = rs.delta(re_.owl_closure(t, schema, kept=True), t)
    return found.where("p = 'type' and o in ('LocalParty', 'Actor')").select("s", F.col("o").alias("c"))


# --- consistency --------------------------------------------------------------------------------------------------------------------

#: The mapping's axioms, and some that it breaks in several ways.
AXIOMS = [
    *[(f"sub {a} {b}", "subclass", a, b) for a, b in sg.SUBCLASSES],
    *[(f"domain {p}", "domain", p, c) for p, c, _ in sg.OBJECT_PROPERTIES],
    *[(f"range {p}", "range", p, c) for p, _, c in sg.OBJECT_PROPERTIES],
    *[(f"inverse {p}", "inverse", p, q) for p, q in sg.INVERSES],
    ("payer", "domain", "priority", "Tagged"),
    ("tagged", "subclass", "Tagged", "Label"),
    ("no label is an event", "disjoint", "Label", "Event"),
    ("a customer is no label", "disjoint", "Customer", "Label"),
    ("one status", "functional", "state", ""),
    ("status is a state", "subproperty", "status", "state"),
    ("whole balance", "datatype", "money", "integer"),
    ("balance is money", "subproperty", "supplierBalance", "money"),
    ("text names", "datatype", "nationName", "string"),
    ("no seat", "subclass", "Seat", "Nothing"),
    ("seat", "range", "basedIn", "Seat"),
    ("agents stay", "disjoint", "Agent", "Seat"),
    ("regions are free", "disjoint", "Region", "Event"),
]
DATATYPE = "CASE WHEN o_kind = 'lit' THEN CASE WHEN o_num IS NOT NULL THEN 'decimal' ELSE 'string' END END"
CLASHES_SQL = f""", ax AS (SELECT * FROM (VALUES {_values(AXIOMS)}) AS ax(axiom, kind, a, b)),
tr AS (SELECT axiom, 'class' AS ak, a AS an, 'class' AS bk, b AS bn FROM ax WHERE kind = 'subclass'
  UNION ALL SELECT axiom, k, a, k, b FROM ax, (VALUES ('out'), ('in'), ('lit')) AS v(k) WHERE kind = 'subproperty'
  UNION ALL SELECT axiom, x, CASE y WHEN 1 THEN a ELSE b END, z, CASE y WHEN 1 THEN b ELSE a END FROM ax, (VALUES ('out', 'in', 1), ('in', 'out', 1), ('out', 'in', 2), ('in', 'out', 2)) AS v(x, z, y) WHERE kind = 'inverse'
  UNION ALL SELECT axiom, k, a, 'class', b FROM ax, (VALUES ('out'), ('lit')) AS v(k) WHERE kind = 'domain'
  UNION ALL SELECT axiom, 'in', a, 'class', b FROM ax WHERE kind = 'range'),
said AS (SELECT s, 'class' AS k, o AS n, NULL::VARCHAR AS dt, NULL::VARCHAR AS v FROM g WHERE p = 'type' UNION ALL SELECT s, 'out', p, NULL, NULL FROM e UNION ALL SELECT o, 'in', p, NULL, NULL FROM e
  UNION ALL SELECT s, 'lit', p, {DATATYPE}, o FROM g WHERE o_kind = 'lit'),
st AS (SELECT s, k, n, dt, min(v) AS lo, max(v) AS hi FROM said GROUP BY ALL),
reach AS (SELECT DISTINCT k AS ik, n AS i, dt AS idt, k, n, dt, []::VARCHAR[] AS x FROM st
  UNION SELECT ik, i, idt, bk, bn, CASE WHEN bk = 'lit' THEN dt END, list_sort(list_append(x, axiom)) FROM reach JOIN tr ON k = ak AND n = an WHERE NOT list_contains(x, axiom)),
own AS (SELECT s, lo, hi, r.* FROM st JOIN reach r ON st.k = r.ik AND st.n = r.i AND st.dt IS NOT DISTINCT FROM r.idt),
cl AS (SELECT s, 'nothing' AS clash, x FROM own WHERE k = 'class' AND n = 'Nothing'
  UNION SELECT a.s, 'disjoint', list_sort(list_distinct(a.x || c.x || [axiom])) FROM own a JOIN ax ON ax.kind = 'disjoint' AND a.k = 'class' AND a.n = ax.a JOIN own c ON c.s = a.s AND c.k = 'class' AND c.n = ax.b
  UNION SELECT s, 'datatype', list_sort(list_distinct(x || [axiom])) FROM own JOIN ax ON kind = 'datatype' AND k = 'lit' AND n = a AND dt IS DISTINCT FROM b
  UNION SELECT a.s, 'functional', list_sort(list_distinct(a.x || c.x || [axiom])) FROM own a JOIN ax ON ax.kind = 'functional' AND a.k = 'lit' AND a.n = ax.a JOIN own c ON c.s = a.s AND c.k = 'lit' AND c.n = a.n
    WHERE NOT (a.lo = a.hi AND c.lo = c.hi AND a.lo = c.lo AND a.dt = c.dt)),
by_set AS (SELECT x, string_agg(DISTINCT clash, ',' ORDER BY clash) AS clash, count(DISTINCT s) AS n, min(s) AS example FROM cl GROUP BY x)"""


def _typed(t: DataFrame) -> DataFrame:
    return t.withColumn("o_dt", F.expr(DATATYPE))


def _axioms(spark: SparkSession) -> DataFrame:
    return inline(spark, AXIOMS, "axiom string, kind string, a string, b string")


@on_kept_graph(f"{CLASHES_SQL} SELECT array_to_string(x, '; ') AS axioms, clash, n, example FROM by_set WHERE NOT EXISTS (SELECT 1 FROM by_set y WHERE len(y.x) < len(by_set.x) AND list_has_all(by_set.x, y.x))")
def inconsistent_axioms(t: DataFrame, _: dict[str, DataFrame]) -> DataFrame:
    found = cs.inconsistent_axioms(_typed(t), _axioms(t.sparkSession))
    return found.select(F.array_join("axioms", "; ").alias("axioms"), "clash", "n", "example")


@on_kept_graph(f"{CLASHES_SQL} SELECT clash, count(DISTINCT s) AS n FROM cl GROUP BY clash")
def clash_counts(t: DataFrame, _: dict[str, DataFrame]) -> DataFrame:
    return cs.clashes(_typed(t), _axioms(t.sparkSession)).groupBy("clash").agg(F.count_distinct("s").alias("n"))


# --- maintenance --------------------------------------------------------------------------------------------------------------------

KEPT_RULES = """
frequent: Customer(?c) ^ placedBy(?a, ?c) ^ placedBy(?b, ?c) ^ placedBy(?d, ?c) ^ DifferentFrom(?a, ?b) ^ DifferentFrom(?b, ?d) ^ DifferentFrom(?a, ?d) -> Frequent(?c)
within_1: inNation(?x, ?y) -> within(?x, ?y)
within_2: inRegion(?x, ?y) -> within(?x, ?y)
within_3: within(?x, ?y) ^ within(?y, ?z) -> within(?x, ?z)
reaches: placedBy(?o, ?c) ^ within(?c, ?r) -> reaches(?o, ?r)
busy: Order(?o) ^ placedBy(?o, ?c) ^ Frequent(?c) -> Busy(?o)
"""
CHANGED = "o_orderkey % 13 <> 0"
MOVED = "CASE WHEN o_orderkey % 17 = 0 THEN o_custkey + 1 ELSE o_custkey END"


def _changed_graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The orders' triples before, and after a thirteenth of the orders are gone and a seventeenth have moved to another customer."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    of = lambda df: reduce(DataFrame.unionByName, sg.table_triples(df, "orders"))
    return {"before": of(rows), "after": of(rows.where(CHANGED).withColumn("o_custkey", F.expr(MOVED)))}


def incremental_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules derive after a change of one table: the table's removed and added triples, carried through the closure of the graph before."""
    t, changed = sg.kept_graph(spark, sf_dir), _changed_graph(spark, sf_dir)
    rules = re_.rules_of(re_.rule_lines(spark, KEPT_RULES.split("\n")))
    path = f"{shared_folder(spark)}/closure-{uuid.uuid4().hex}"
    mt.write_closure(re_.run_rules(t, rules, kept=True), path)
    removed, added = mt.table_changes(changed["before"], changed["after"])
    base = t.select(*re_.SPO).join(removed, re_.SPO, "left_anti").unionByName(added)
    gone, new = mt.maintain(mt.read_closure(spark, path), base, removed, added, rules)
    mt.refresh_closure(spark, path, gone, new)
    return mt.read_closure(spark, path).where("p in ('reaches', 'within') or (p = 'type' and o in ('Frequent', 'Busy'))").select("s", "p", "o")


QUERIES["incremental_run"] = incremental_run
ORACLES["incremental_run"] = f"""{G}, pl AS (SELECT o_orderkey, 'Order_' || o_orderkey AS s, 'Customer_' || (CASE WHEN o_orderkey % 97 = 0 THEN -o_orderkey ELSE {MOVED} END) AS c FROM orders WHERE {CHANGED}),
w AS (SELECT s, o FROM e WHERE p IN ('inNation', 'inRegion') UNION SELECT x.s, y.o FROM e x JOIN e y ON x.o = y.s WHERE x.p = 'inNation' AND y.p = 'inRegion'),
fr AS (SELECT c FROM pl WHERE c IN (SELECT node FROM ty) GROUP BY c HAVING count(DISTINCT s) >= 3)
SELECT s, 'within' AS p, o FROM w UNION SELECT pl.s, 'reaches', w.o FROM pl JOIN w ON pl.c = w.s UNION SELECT c, 'type', 'Frequent' FROM fr UNION SELECT pl.s, 'type', 'Busy' FROM pl JOIN fr USING (c)"""


# --- justifications with premises ---------------------------------------------------------------------------------------------------

WHY = f""", d AS (SELECT s, c AS o, 1 AS rank, ['(' || s || ', ' || p || ', _) stated', '(' || p || ', domain, ' || c || ') in the schema'] AS why FROM g JOIN {DOM} USING (p)),
r AS (SELECT o AS s, c AS o, 2 AS rank, ['(_, ' || p || ', ' || o || ') stated', '(' || p || ', range, ' || c || ') in the schema'] AS why FROM e JOIN {RAN} USING (p)),
b AS (SELECT node AS s, b AS o, 3 AS rank, ['(' || node || ', type, ' || a || ') stated', '(' || a || ', subClassOf, ' || b || ') in the schema'] AS why FROM ty JOIN {SUB} ON c = a),
made AS (SELECT node AS s, c AS o, 0 AS rank, []::VARCHAR[] AS why FROM ty UNION ALL FROM d UNION ALL FROM r UNION ALL FROM b),
best AS (SELECT * FROM made QUALIFY row_number() OVER (PARTITION BY s, o ORDER BY rank, why) = 1),
asked AS (SELECT s, o FROM d UNION SELECT s, o FROM r UNION SELECT s, o FROM b UNION SELECT node, 'Agent' FROM ty),
told AS (SELECT s, o, CASE rank WHEN 0 THEN 'already_exists' WHEN 1 THEN 'domain' WHEN 2 THEN 'range' WHEN 3 THEN 'subclass' ELSE 'unknown' END AS rule, coalesce(array_to_string(why, '; '), '') AS premises, CASE WHEN rank IS NULL THEN 'low' ELSE 'high' END AS confidence FROM asked LEFT JOIN best USING (s, o))"""


def _asked(t: DataFrame, k: dict[str, DataFrame]) -> DataFrame:
    """Types that three rules conclude in a step, and a type of everything, which some of them do not explain."""
    step = rs.one_step(t, t, {x: k[x] for x in ("domain", "range", "subclass")}).select("s", "p", "o")
    return step.union(t.where("p = 'type'").select("s", "p", F.lit("Agent"))).distinct()


def _told(found: DataFrame) -> DataFrame:
    return found.select("s", "o", "rule", F.array_join("premises", "; ").alias("premises"), "confidence")


@on_kept_graph(f"{WHY} SELECT * FROM told")
def justify_premises(t: DataFrame, k: dict[str, DataFrame]) -> DataFrame:
    return _told(rs.justified(_asked(t, k), t, k))


@on_kept_graph(f"{WHY} SELECT * FROM told WHERE s = 'Customer_7' AND o = 'Party'")
def justify_one(t: DataFrame, k: dict[str, DataFrame]) -> DataFrame:
    """One triple explained."""
    return _told(rs.justified(inline(t.sparkSession, [("Customer_7", "type", "Party")], "s string, p string, o string"), t, k))


# --- tiers --------------------------------------------------------------------------------------------------------------------------

DECLARED = [(c,) for c in ("Region", "Nation", "Customer", "Supplier", "Part", "Order", "Depot", "RouteMap")]
ENDS = " OR ".join(f"c LIKE '%{e}'" for e in ti.TRANSACTION_ENDS)
TIERS_SQL = f""", n AS (SELECT c, count(DISTINCT node) AS n FROM (VALUES {_values(DECLARED)}) AS v(c) LEFT JOIN ty USING (c) GROUP BY c),
tier AS (SELECT c, n, CASE WHEN c = 'Region' THEN 'catalog' WHEN n = 0 THEN 'inferred' WHEN n > {ti.MASTER_MOST} OR {ENDS} THEN 'transaction' ELSE 'master' END AS tier FROM n)"""


def _tiers(t: DataFrame) -> DataFrame:
    return ti.class_tiers(t, inline(t.sparkSession, DECLARED, "c string"), ["Region"])


@on_kept_graph(f"{TIERS_SQL} SELECT * FROM tier")
def class_tiers(t: DataFrame, _: dict[str, DataFrame]) -> DataFrame:
    return _tiers(t)


ALLOWED = [(k, m, x) for k, own in ti.TIERS.items() for m, x in zip(("dangling", "coverage", "orphan"), own, strict=True)]


@on_kept_graph(f"""{TIERS_SQL}, al AS (SELECT tier, metric, allowed::DOUBLE AS allowed FROM (VALUES {_values(ALLOWED)}) AS al(tier, metric, allowed)), dm AS (SELECT DISTINCT p, c FROM {DOM}),
m AS (SELECT c, 'orphan' AS metric, count(*) FILTER (node NOT IN (SELECT o FROM e)) / count(*)::DOUBLE AS value, c NOT IN (SELECT c FROM {RAN}) AS exempt FROM ty GROUP BY c
  UNION ALL SELECT c, 'dangling', count(*) FILTER (o NOT IN (SELECT node FROM ty)) / count(*)::DOUBLE, false FROM e JOIN ty ON e.s = ty.node GROUP BY c
  UNION ALL SELECT ty.c, 'coverage', count(*) FILTER ((node, p) IN (SELECT s, p FROM g)) * 100.0::DOUBLE / count(*), false FROM ty JOIN dm ON dm.c = ty.c GROUP BY ty.c)
SELECT c, tier, metric, round(value, 6) AS value, allowed, exempt OR CASE metric WHEN 'coverage' THEN value >= allowed ELSE value <= allowed END AS passed FROM m JOIN tier USING (c) JOIN al USING (tier, metric)""")
def tier_report(t: DataFrame, k: dict[str, DataFrame]) -> DataFrame:
    return ti.tier_report(t, _tiers(t), k["domain"], k["range"])
