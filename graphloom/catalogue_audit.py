"""Queries of audits: schemas, inverses, links, shapes, checks that never fire, betweenness; each with its oracle where SQL can tell it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalogue import CLOSED, QUERIES, _local, _values, on_graph, query
from graphloom.operators import audit as au
from graphloom.operators import reasoning as rs
from graphloom.plans import star_graph as sg
from graphloom.sources.tables import inline, table

# the mapping's schema with defects: an unused class, a pair that others imply, an inverse declared one way, groups of one class and of none
BELOW = [*sg.SUBCLASSES, ("Customer", "Agent"), ("Ghost", "Party")]
ALL_CLASSES = sorted({(c,) for pair in BELOW for c in pair} | {("Part",)})
GROUPS = [("places", "Nation"), ("places", "Region"), ("lonely", "Part"), ("empty", None)]
DECLARED = [*sg.INVERSES, ("placed", "placedBy")]


def _sql_values(rows: list[tuple]) -> str:
    return _values(rows).replace("None", "NULL")


@query(f"""WITH RECURSIVE c(c) AS (VALUES {_values(ALL_CLASSES)}), b(a, b) AS (VALUES {_values(BELOW)}), pr(p, d, r) AS (VALUES {_values(sg.OBJECT_PROPERTIES)}), dp(p, d) AS (VALUES {_values(sg.DATA_PROPERTIES)}),
i(p, q) AS (VALUES {_values(DECLARED)}), k(g, c) AS (VALUES {_sql_values(GROUPS)}), up AS (SELECT a, b FROM b UNION SELECT u.a, z.b FROM up u JOIN b z ON u.b = z.a)
SELECT 'lazy_class' AS rule, c AS subject FROM c WHERE c NOT IN (SELECT d FROM pr UNION SELECT r FROM pr UNION SELECT d FROM dp)
UNION SELECT 'lonely_disjoint', g FROM k GROUP BY g HAVING count(DISTINCT c) <= 1
UNION SELECT 'asymmetric_inverse', p || ' ' || q FROM i WHERE (q, p) NOT IN (SELECT p, q FROM i)
UNION SELECT 'redundant_subclass', y.a || ' ' || y.b FROM b y WHERE EXISTS (SELECT 1 FROM b x JOIN up u ON u.a = x.b WHERE u.b = y.b AND x.a = y.a AND x.b <> y.b)""")
def audit_antipatterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    properties = inline(spark, [*sg.OBJECT_PROPERTIES, *[(p, d, None) for p, d in sg.DATA_PROPERTIES]], "p string, domain string, range string")
    return au.antipatterns(inline(spark, ALL_CLASSES, "c string"), properties, inline(spark, BELOW, "a string, b string"), inline(spark, DECLARED, "p string, q string"), inline(spark, GROUPS, "g string, c string"))


# placed goes back from customers to orders; nationOfCustomer is declared from regions, which don't go with inNation's nations; basedOf gives no domain
BACK = [("placed", "Party", "Order"), ("nationOfCustomer", "Region", "Customer"), ("basedOf", None, "Supplier")]
FIT = [*sg.INVERSES, ("basedIn", "basedOf")]
on_graph(
    "inverse_complete_fitting", " SELECT s, p, o FROM g UNION SELECT o, 'placed', s FROM e WHERE p = 'placedBy'",
    lambda t, k: au.inverse_complete_fitting(t, _local(t, FIT, "p string, q string"), _local(t, sg.OBJECT_PROPERTIES + BACK, "p string, domain string, range string"), k["subclass"]).select("s", "p", "o"),
)


OWN, GEO, FAR = "http://a.example/", "http://geo.example/", "http://far.example/"
IRI_OF = "CASE WHEN {c} LIKE 'Region%' THEN '" + GEO + "' ELSE '" + OWN + "' END || {c}"
LINKED = [(OWN + "onto", "imports", GEO), (OWN + "onto", "imports", FAR), (OWN + "Nation", "subClassOf", GEO + "Place"), *[(OWN + a, "subClassOf", OWN + b) for a, b in sg.SUBCLASSES], (GEO + "Place", "subClassOf", GEO + "Thing")]
on_graph(
    "interlinking",
    f""", x AS (SELECT {IRI_OF.format(c='s')} AS s, p, {IRI_OF.format(c='o')} AS o FROM g WHERE o_kind = 'iri' UNION ALL SELECT * FROM (VALUES {_values(LINKED)}) AS v(s, p, o)),
    y AS (SELECT *, o LIKE '{GEO}%' OR o LIKE '{FAR}%' AS away FROM x), subj AS (SELECT s FROM x UNION SELECT {IRI_OF.format(c='s')} FROM g),
    n AS (SELECT round(count(*) FILTER (away) * 100.0::DOUBLE / count(*), 2) AS external_pct, round(count(*) FILTER (away AND p = 'subClassOf') * 100.0::DOUBLE / count(*) FILTER (p = 'subClassOf'), 2) AS superclass_pct,
        count(DISTINCT o) FILTER (p = 'imports') AS n_imports FROM y),
    r AS (SELECT count(*) AS n_referenced, count(*) FILTER (o IN (SELECT s FROM subj)) AS n_resolved FROM (SELECT DISTINCT o FROM y WHERE away AND o NOT IN ('{GEO}', '{FAR}'))),
    z AS (SELECT *, n_imports > 0 AND n_referenced > 0 AND n_resolved = 0 AS inert FROM n, r),
    w AS (SELECT *, (CASE WHEN n_imports > 0 AND NOT inert THEN 30 ELSE 0 END + CASE WHEN external_pct >= 5 THEN 40 WHEN external_pct >= 1 THEN 20 ELSE 0 END + CASE WHEN superclass_pct >= 10 THEN 30 WHEN superclass_pct >= 3 THEN 15 ELSE 0 END)::INT AS score FROM z)
    SELECT *, score >= 60 AS passed FROM w""",
    lambda t, _: au.interlinking(
        t.select(F.expr(IRI_OF.format(c="s")).alias("s"), "p", F.when(F.col("o_kind") == "iri", F.expr(IRI_OF.format(c="o"))).otherwise(F.col("o")).alias("o"), "o_kind")
        .unionByName(_local(t, [(*x, "iri") for x in LINKED], "s string, p string, o string, o_kind string")),
        OWN, [GEO, FAR],
    ),
)

LIMITS = [("Order", "status", 1, 1), ("Customer", "inNation", 1, None), ("Party", "balance", None, 1)]
SHAPES = [("Order", "status", 1, 2), ("Customer", "inNation", 1, None), ("Order", "placedBy", 1, 1)]


@query(f"""WITH a(c, p, low, high) AS (VALUES {_sql_values(LIMITS)}), b(c, p, low, high) AS (VALUES {_sql_values(SHAPES)})
SELECT coalesce(a.c, b.c) AS c, coalesce(a.p, b.p) AS p, CASE WHEN b.c IS NULL THEN 'only_schema' WHEN a.c IS NULL THEN 'only_shapes' WHEN a.low IS NOT DISTINCT FROM b.low AND a.high IS NOT DISTINCT FROM b.high THEN 'same' ELSE 'differs' END AS status
FROM a FULL JOIN b ON a.c = b.c AND a.p = b.p""")
def cardinality_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.cardinality_sync(*[inline(spark, rows, "c string, p string, low int, high int") for rows in (LIMITS, SHAPES)])


ASKED = [("Event", "status", 1, 1, None), ("Customer", "inNation", 1, None, "Place"), ("Order", "placedBy", 1, 1, "Party"), ("Party", "basedIn", 1, None, "Place")]
on_graph(
    "shape_violations",
    f"""{CLOSED}, k(c, p, low, high, target) AS (VALUES {_sql_values(ASKED)}),
    m AS (SELECT k.*, closed.node FROM closed JOIN k USING (c)), n AS (SELECT s, p, count(DISTINCT o) AS n FROM g GROUP BY s, p), h AS (SELECT DISTINCT e.s, e.p, closed.c AS target FROM e JOIN closed ON closed.node = e.o)
    SELECT m.c, m.p, count(*) AS n_members, count(*) FILTER (coalesce(n.n, 0) < coalesce(low, 0) OR coalesce(n.n, 0) > coalesce(high, 1000) OR (m.target IS NOT NULL AND h.s IS NULL)) AS n_bad
    FROM m LEFT JOIN n ON n.s = m.node AND n.p = m.p LEFT JOIN h ON h.s = m.node AND h.p = m.p AND h.target = m.target GROUP BY m.c, m.p""",
    lambda t, k: au.shape_violations(t, _local(t, ASKED, "c string, p string, low int, high int, target string"), k["subclass"]),
)

NOISY = "CASE WHEN o_kind = 'lit' THEN CASE WHEN p = 'total' AND s LIKE '%3' THEN 'string' WHEN p = 'brand' AND s LIKE '%5' THEN NULL WHEN o_num IS NULL THEN 'string' ELSE 'decimal' END END"
on_graph(
    "prune_more_noise",
    f""", n AS (SELECT s, p, o, o_kind, {NOISY} AS dt, CASE WHEN s LIKE 'Region%' THEN 'lit' ELSE 'iri' END AS sk FROM g UNION ALL SELECT DISTINCT s, x, s, 'iri', NULL, 'iri' FROM g, (VALUES ('sameAs'), ('equivalentClass'), ('subClassOf')) AS v(x) WHERE s LIKE 'Nation%')
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p = 'sameAs' THEN 'self_same' WHEN p = 'equivalentClass' THEN 'self_equivalent' WHEN sk = 'lit' THEN 'literal_subject' WHEN p = 'subClassOf' THEN 'self_subclass'
    WHEN (p = 'total' AND dt <> 'decimal') OR (p = 'brand' AND dt IS NULL) THEN 'other_datatype' ELSE 'keep' END AS reason FROM n) GROUP BY reason""",
    lambda t, _: rs.prune_noise(_noisy(t), ["total", "brand"], ["inNation"], {"total": "decimal", "brand": "string"}).groupBy("reason").agg(F.count("*").alias("n")),
)


def _noisy(t: DataFrame) -> DataFrame:
    """The graph with data types and kinds of subjects, some of them wrong, and pairs of a nation with itself."""
    told = t.select("s", "p", "o", "o_kind", F.expr(NOISY).alias("o_dt"), F.when(F.col("s").startswith("Region"), "lit").otherwise("iri").alias("s_kind"))
    loops = t.where("p = 'type' and s like 'Nation%'").select("s", F.explode(F.array(F.lit("sameAs"), F.lit("equivalentClass"), F.lit("subClassOf"))).alias("p"), F.col("s").alias("o"))
    return told.unionByName(loops.withColumns({"o_kind": F.lit("iri"), "o_dt": F.lit(None).cast("string"), "s_kind": F.lit("iri")}))


# every event is a mutant of its type's category; a user's number tells the check that was tried on it
TRIALS = {"mutant": "event_id", "category": "event_type", "check": "'C' || user_id % 6", "caught": "user_id % 6 = 0 AND event_type <> 'error'", "adds": "event_id % 2 = 0", "healthy": "user_id % 6 <> 3"}
TRIALS_SQL = "SELECT " + ", ".join(f"{x} AS {c}" for c, x in TRIALS.items()).replace(" AS check", ' AS "check"') + " FROM events"
REACH = [("click", "C1"), ("click", "C2"), ("error", "C1")]


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*[F.expr(x).alias(c) for c, x in TRIALS.items()])


@query(f"SELECT category, count(DISTINCT mutant) AS n_mutants, count(DISTINCT mutant) FILTER (caught) AS n_caught FROM ({TRIALS_SQL}) GROUP BY category HAVING count(DISTINCT mutant) FILTER (caught) < count(DISTINCT mutant)")
def blind_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.blind_spots(_trials(spark, sf_dir))


@query(f"""WITH x AS (SELECT "check", count(*) FILTER (caught) AS n, count(*) FILTER (adds AND (category, "check") IN (VALUES {_values(REACH)})) AS exposure, count(*) FILTER (NOT healthy) AS n_baseline_failing FROM ({TRIALS_SQL}) GROUP BY "check")
SELECT "check", exposure, n_baseline_failing, CASE WHEN "check" = 'C5' THEN 'no_probe_available' WHEN n_baseline_failing > 0 AND n_baseline_failing = exposure THEN 'structurally_undetectable' WHEN exposure < 8 THEN 'insufficient_exposure' ELSE 'consider_removal' END AS verdict
FROM x WHERE n = 0 AND "check" <> 'C4'""")
def dead_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.dead_checks(_trials(spark, sf_dir), inline(spark, [("C4",)], "check string"), inline(spark, REACH, "category string, check string"), ["C5"])


def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes' betweenness from all nodes; tests hold the operator and the query against counting every shortest path, which is too much for SQL."""
    edges = sg.graph(spark, sf_dir).where("o_kind = 'iri' and p <> 'type'").select(F.col("s").alias("a"), F.col("o").alias("b"))
    return au.exact_betweenness(edges).select("node", F.round("betweenness", 9).alias("betweenness"))


QUERIES["betweenness"] = betweenness
