"""Further queries over the driver's tables: ingest, paths, equality, exports, questions and their history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalogue import DOM, INV, KINDS_SQL, LINKS, NOT_TYPED, QUERIES, RAN, UP, _entailed, _local, _values, on_graph, query
from graphloom.functions import coercion as co
from graphloom.operators import analytics as an
from graphloom.operators import evaluation as ev
from graphloom.operators import governance as gv
from graphloom.operators import graph as gr
from graphloom.operators import ingest as ig
from graphloom.operators import reasoning as rs
from graphloom.plans import star_graph as sg
from graphloom.sources.tables import inline, table

# --- coercion and ingest ------------------------------------------------------------------------------------------------------------

#: Date forms (Spark's pattern) and what they keep of a time; the last two can't always be read.
FORMS = [
    ("yyyy-MM-dd'T'HH:mm:ss", "second"), ("yyyy-MM-dd'T'HH:mm:ss.SSS", "second"), ("yyyy-MM-dd HH:mm:ss.SSSSSS", "second"), ("yyyy-MM-dd HH:mm:ss", "second"), ("yyyy-MM-dd HH:mm", "minute"), ("yyyy-MM-dd", "day"),
    ("yyyy/MM/dd HH:mm:ss.S", "second"), ("yyyy/MM/dd HH:mm:ss", "second"), ("yyyy/MM/dd HH:mm", "minute"), ("yyyy/M/d", "day"), ("yyyy.MM.dd HH:mm:ss.SSS", "second"), ("yyyy.MM.dd HH:mm:ss", "second"),
    ("yyyy.MM.dd", "day"), ("yyyyMMdd", "day"), ("yyyyMMddHHmmss", "second"), ("yyyy-MM-dd'T'HH:mm:ss'Z'", "second"), ("dd.MM.yyyy", "guarded"), ("MM-dd-yyyy", "guarded"),
]
READ = " ".join(f"WHEN {k} THEN " + ("CASE WHEN day(ts) > 12 OR month(ts) > 12 THEN date_trunc('day', ts) END" if keep == "guarded" else f"date_trunc('{keep}', ts)") for k, (_, keep) in enumerate(FORMS))


@query(f"SELECT event_id, CASE event_id % {len(FORMS)} {READ} END::TIMESTAMP AS read FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's time, written in one of all forms by its number and read back; day and month without a known order only where one can't be a month."""
    ts = F.date_trunc("second", "ts")
    text = F.lit(None).cast("string")
    for k, (form, _) in enumerate(FORMS):
        text = F.when(F.col("event_id") % len(FORMS) == k, F.date_format(ts, form)).otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", co.to_timestamp(text).alias("read"))


LOST = {
    "total": ("CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN '12x' ELSE o_totalprice::VARCHAR END", "CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN '12x' ELSE cast(o_totalprice AS string) END"),
    "day": ("CASE WHEN o_orderkey % 13 = 0 THEN '03/04/2024' WHEN o_orderkey % 17 = 0 THEN ' ' ELSE '2024-01-02' END",) * 2,
    "cust": ("CASE WHEN o_orderkey % 97 = 0 THEN '-5' WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_custkey::VARCHAR END", "CASE WHEN o_orderkey % 97 = 0 THEN '-5' WHEN o_orderkey % 19 = 0 THEN NULL ELSE cast(o_custkey AS string) END"),
}
MANIFEST_SQL = """WITH x AS (SELECT {cells} FROM orders)
SELECT 'total' AS "column", count(*) AS n_rows, 0::BIGINT AS n_empty, count(*) FILTER (total = 'n/a') AS n_sentinel, count(*) FILTER (total = '12x') AS n_failed, 0::BIGINT AS n_unverified FROM x
UNION ALL SELECT 'day', count(*), count(*) FILTER (trim(day) = ''), 0, count(*) FILTER (day = '03/04/2024'), 0 FROM x
UNION ALL SELECT 'cust', count(*), count(*) FILTER (cust IS NULL), 0, 0, count(*) FILTER (cust IS NOT NULL AND cust NOT IN (SELECT c_custkey::VARCHAR FROM customer)) FROM x""".replace("{cells}", ", ".join(f"{x[0]} AS {c}" for c, x in LOST.items()))


@query(MANIFEST_SQL)
def loss_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(*[F.expr(x[1]).alias(c) for c, x in LOST.items()])
    return ig.loss_manifest(rows, ["total"], ["day"], {"cust": (table(spark, sf_dir, "customer"), "c_custkey")})


@query(f"""WITH m AS ({MANIFEST_SQL}), t AS (SELECT sum(n_rows) AS cells, sum(n_sentinel) AS a, sum(n_failed) AS b, sum(n_unverified) AS c FROM m),
l AS (SELECT 'n_sentinel' AS loss, a::BIGINT AS n, a / cells::DOUBLE AS rate, 0.2 AS allowed FROM t UNION ALL SELECT 'n_failed', b::BIGINT, b / cells::DOUBLE, 0.01 FROM t UNION ALL SELECT 'n_unverified', c::BIGINT, c / cells::DOUBLE, 0 FROM t)
SELECT loss, n, rate, rate <= allowed AS passed FROM l""")
def loss_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ig.loss_budget(loss_manifest(spark, sf_dir), inline(spark, [("n_sentinel", 0.2), ("n_failed", 0.01)], "loss string, allowed double"))


SAFE = r"regexp_replace(trim({x}), '[^\p{{L}}\p{{M}}\p{{N}}_-]', '_', 'g')"


@query(
    f"SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN {SAFE.format(x='p_name')} || '_' || {SAFE.format(x='p_brand')} || CASE WHEN p_partkey % 3 = 0 THEN '_2024-01-02_03_04' ELSE '' END END AS timed, "
    f"{SAFE.format(x='p_name')} AS single, CASE WHEN p_partkey % 10 <> 0 THEN {SAFE.format(x='p_name')} || '_' || {SAFE.format(x='p_brand')} END AS authoritative FROM part"
)
def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts by name, and by name and brand with a time that a third of them has; every tenth lacks a brand."""
    df = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS p_brand", "CASE WHEN p_partkey % 3 = 0 THEN '2024-01-02 03:04' ELSE '' END AS made")
    return df.select("p_partkey", ig.row_key(["p_name", "p_brand"], time="made").alias("timed"), ig.row_key("p_name", time="made").alias("single"), ig.row_key(["p_name", "p_brand"], True, "made").alias("authoritative"))


@query("""WITH o AS (SELECT 'Order_' || o_orderkey AS s, o_orderpriority AS code, regexp_replace(o_orderpriority, '[^\\p{L}\\p{M}\\p{N}_-]+', '_', 'g') AS c FROM orders)
SELECT 'Priority_' || c AS s, 'type' AS p, 'Priority' AS o FROM o UNION SELECT s, 'hasPriority', 'Priority_' || c FROM o UNION SELECT 'Priority_' || c, 'priorityOf', s FROM o UNION SELECT 'Priority_' || c, 'label', 'urgent' FROM o WHERE code = '1-URGENT'""")
def dimension_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = inline(spark, [("1-URGENT", "urgent")], "code string, label string")
    return ig.promoted_dimension(table(spark, sf_dir, "orders"), F.concat(F.lit("Order_"), F.col("o_orderkey").cast("string")), "o_orderpriority", "Priority", "hasPriority", "priorityOf", "label", labels)


on_graph(
    "fk_promotion", " SELECT s, p, o FROM e WHERE p = 'placedBy' AND o IN (SELECT node FROM ty) UNION SELECT o, 'type', 'Customer' FROM e WHERE p = 'placedBy' AND o IN (SELECT node FROM ty)",
    lambda t, _: ig.promoted(t.where("p = 'placedBy'").select("s", "p", "o"), t.where("p = 'type'").select(F.col("s").alias("node")), "Customer"),
)
on_graph(
    "resolve_report", f" SELECT p, count(*) FILTER (NOT o {NOT_TYPED}) AS n_resolved, count(*) FILTER (o {NOT_TYPED}) AS n_unresolved FROM e GROUP BY p",
    lambda t, _: ig.resolve_report(t.where("o_kind = 'iri' and p <> 'type'"), t.where("p = 'type'").select(F.col("s").alias("node"))),
)

# --- patterns and paths -------------------------------------------------------------------------------------------------------------

NODES = "nodes AS (SELECT s AS n FROM e WHERE p IN ('inNation', 'inRegion') UNION SELECT o FROM e WHERE p IN ('inNation', 'inRegion'))"


def _path_nodes(t: DataFrame) -> DataFrame:
    own = t.where("p in ('inNation', 'inRegion')")
    return own.select(F.col("s").alias("node")).union(own.select("o")).distinct()


on_graph("path_sequence_inverse", " SELECT DISTINCT a.s AS a, b.s AS b FROM e a JOIN e b ON a.o = b.o WHERE a.p = 'basedIn' AND b.p = 'inNation'", lambda t, _: gr.sequence_path(gr.step(t, "basedIn"), gr.inverse_path(gr.step(t, "inNation"))))
on_graph("path_alternative", " SELECT DISTINCT a.s AS a, b.o AS b FROM e a JOIN e b ON a.o = b.s WHERE a.p IN ('inNation', 'basedIn') AND b.p = 'inRegion'", lambda t, _: gr.sequence_path(gr.step(t, "inNation", "basedIn"), gr.step(t, "inRegion")))
on_graph(
    "path_star", f", st AS (SELECT s AS a, o AS b FROM e WHERE p IN ('inNation', 'inRegion')), {NODES}, pairs AS (SELECT n AS a, n AS b FROM nodes UNION SELECT p.a, st.b FROM pairs p JOIN st ON p.b = st.a) SELECT a, b FROM pairs",
    lambda t, _: gr.star_path(gr.step(t, "inNation", "inRegion"), _path_nodes(t)),
)
on_graph("path_maybe", f", {NODES} SELECT s AS a, o AS b FROM e WHERE p = 'inRegion' UNION SELECT n, n FROM nodes", lambda t, _: gr.maybe_path(gr.step(t, "inRegion"), _path_nodes(t)))
on_graph(
    "group_concat_sample", " SELECT s AS x, string_agg(o, '|' ORDER BY o) AS all_values, min(o) AS one FROM g WHERE p = 'status' GROUP BY s",
    lambda t, _: gr.match(t, "?x", "status", "?v").groupBy("x").agg(gr.group_concat("v", "|").alias("all_values"), gr.sample("v").alias("one")),
)
on_graph(
    "named_graphs", " SELECT split_part(s, '_', 1) AS g, count(*) AS n FROM g WHERE p = 'type' AND split_part(s, '_', 1) <> 'Order' GROUP BY 1",
    lambda t, _: gr.match(t.withColumn("g", F.substring_index("s", "_", 1)), "?x", "type", "?c", g="?g").where("g <> 'Order'").groupBy("g").agg(F.count("*").alias("n")),
)
on_graph(
    "values_undef", " SELECT s AS x, o AS n FROM e WHERE p = 'basedIn' AND (o = 'Nation_1' OR (s = 'Supplier_2' AND o = 'Nation_' || split_part(o, '_', 2)) OR (s = 'Supplier_3' AND o = 'Nation_99'))",
    lambda t, _: gr.values(gr.match(t, "?x", "basedIn", "?n").where("not (x = 'Supplier_2' and n = 'Nation_1')"), ["x", "n"], [(None, "Nation_1"), ("Supplier_2", None), ("Supplier_3", "Nation_99")]).unionByName(gr.match(t, "?x", "basedIn", "?n").where("x = 'Supplier_2' and n = 'Nation_1'")),
)
on_graph(
    "optional_filter_both", " SELECT a.s AS x, a.o_num AS total, b.o AS status FROM g a LEFT JOIN g b ON b.s = a.s AND b.p = 'status' AND (a.o_num > 150000 OR b.o = 'X') WHERE a.p = 'total'",
    lambda t, _: gr.optional(gr.match(t, "?x", "total", "?text", number="total").select("x", "total"), gr.match(t, "?x", "status", "?status"), (F.col("total") > 150000) | (F.col("status") == "X")),
)

# --- reasoning ----------------------------------------------------------------------------------------------------------------------

EXTRA = {
    "equivalent_class": ([("Customer", "Buyer")], "a string, b string"), "subproperty": ([("inNation", "located"), ("basedIn", "located")], "a string, b string"), "equivalent_property": ([("located", "placedIn")], "a string, b string"),
    "symmetric": ([("inRegion",)], "p string"), "has_value": ([("BuildingBuyer", "segment", "BUILDING", "lit")], "c string, p string, o string, o_kind string"), "some_values": ([("Located", "located", "Nation")], "c string, p string, d string"),
    "all_values": ([("BuildingBuyer", "inNation", "Home")], "c string, p string, d string"),
}
EXTRA_SQL = """, lo AS (SELECT s, o FROM e WHERE p IN ('inNation', 'basedIn')) SELECT s, p, o FROM g UNION SELECT node, 'type', 'Buyer' FROM ty WHERE c = 'Customer' UNION SELECT s, 'located', o FROM lo UNION SELECT s, 'placedIn', o FROM lo
UNION SELECT o, 'inRegion', s FROM e WHERE p = 'inRegion' UNION SELECT s, 'type', 'BuildingBuyer' FROM g WHERE p = 'segment' AND o = 'BUILDING' UNION SELECT s, 'type', 'Located' FROM lo WHERE o IN (SELECT node FROM ty WHERE c = 'Nation')
UNION SELECT o, 'type', 'Home' FROM e WHERE p = 'inNation' AND s IN (SELECT s FROM g WHERE p = 'segment' AND o = 'BUILDING')"""
on_graph("rl_more_rules", EXTRA_SQL, lambda t, _: rs.fixpoint(t, {k: _local(t, *v) for k, v in EXTRA.items()}).select("s", "p", "o"))
on_graph(
    "rl_equality", ", m AS (SELECT s, min(s) OVER (PARTITION BY o) AS least FROM e WHERE p = 'inRegion') SELECT DISTINCT coalesce(a.least, x.s) AS s, p, coalesce(b.least, x.o) AS o FROM (SELECT s, p, o, o_kind FROM g UNION SELECT o, 'onlyNation', s, 'iri' FROM e WHERE p = 'inRegion') x LEFT JOIN m a ON a.s = x.s LEFT JOIN m b ON b.s = x.o AND x.o_kind = 'iri'",
    lambda t, _: rs.closure(t.select(*rs.SPO), {"inverse": _local(t, [("inRegion", "onlyNation")], "p string, q string")}, functional=["onlyNation"]).select("s", "p", "o"),
)
BROKEN = [("Agent", "segment", "BUILDING", "has_value"), ("Party", "inNation", "Place", "some_values"), ("Customer", "inNation", "Place", "some_values")]
on_graph(
    "restriction_violations", f"{UP} SELECT node AS s, 'Agent' AS c, 'segment' AS p, 'BUILDING' AS target, 'has_value' AS kind FROM ty WHERE c IN ('Customer', 'Supplier') AND node NOT IN (SELECT s FROM g WHERE p = 'segment' AND o = 'BUILDING') "
    "UNION ALL SELECT node, 'Party', 'inNation', 'Place', 'some_values' FROM ty WHERE c = 'Supplier' UNION ALL SELECT node, 'Customer', 'inNation', 'Place', 'some_values' FROM ty WHERE c = 'Customer' AND node NOT IN (SELECT s FROM e WHERE p = 'inNation' AND o IN (SELECT node FROM ty WHERE c IN ('Nation', 'Region')))",
    lambda t, k: rs.restriction_violations(t, _local(t, BROKEN, "c string, p string, target string, kind string"), k["subclass"]),
)
on_graph(
    "pollution_removed", " SELECT s, o FROM (SELECT DISTINCT s, CASE WHEN s LIKE '%3' THEN 'Place' ELSE 'Shopper' END AS o FROM e WHERE p = 'inNation') WHERE o = 'Shopper'",
    lambda t, _: rs.without_pollution(t, t.where("p = 'inNation'").select("s", F.lit("type").alias("p"), F.when(F.col("s").endswith("3"), "Place").otherwise("Shopper").alias("o")).distinct(), _local(t, [("Customer", "Place")], "a string, b string")).select("s", "o"),
)
GENERATED = f"""{UP}, closed AS (SELECT node, c FROM ty UNION SELECT node, b FROM ty JOIN up ON c = a), x AS (SELECT *, {KINDS_SQL} AS dt FROM g),
d AS (SELECT 'domain' AS test, p, (s, 'Agent') NOT IN (SELECT node, c FROM closed) AS bad FROM (SELECT DISTINCT s, p FROM g WHERE p IN ('placedBy', 'inNation')) WHERE s IN (SELECT node FROM ty)
UNION ALL SELECT 'range', p, (o, 'Place') NOT IN (SELECT node, c FROM closed) FROM (SELECT DISTINCT o, p FROM e WHERE p IN ('placedBy', 'inNation')) WHERE o IN (SELECT node FROM ty)
UNION ALL SELECT 'datatype', p, dt <> 'string' FROM x WHERE p IN ('status', 'size') AND o_kind = 'lit'
UNION ALL SELECT 'functional', 'status', count(DISTINCT o) > 1 FROM g WHERE p = 'status' GROUP BY s UNION ALL SELECT 'inverse_functional', 'inRegion', count(DISTINCT s) > 1 FROM g WHERE p = 'inRegion' GROUP BY o)
SELECT test, p, count(*) AS n_checked, count(*) FILTER (bad) AS n_bad FROM d GROUP BY test, p"""
on_graph(
    "generated_tests", GENERATED,
    lambda t, k: gv.generated_tests(t.withColumn("o_dt", F.expr(KINDS_SQL)), _local(t, [("placedBy", "Agent"), ("inNation", "Agent")], "p string, c string"), _local(t, [("placedBy", "Place"), ("inNation", "Place")], "p string, c string"), _local(t, [("status", "string"), ("size", "string")], "p string, dt string"), ["status"], ["inRegion"], k["subclass"]),
)

# --- exports ------------------------------------------------------------------------------------------------------------------------

on_graph(
    "lpg_specific_labels", f"{UP} SELECT node AS uri, c AS label FROM ty",
    lambda t, k: an.most_specific(_entailed(t, {x: k[x] for x in ("subclass",)}).where("p = 'type'").select(F.col("s").alias("uri"), F.col("o").alias("label")), k["subclass"]),
)
on_graph(
    "lpg_verification", " SELECT 'nodes' AS what, count(DISTINCT node) AS expected, count(DISTINCT node) AS found, 0::BIGINT AS lost FROM ty UNION ALL SELECT 'relationships', count(*), count(*) FILTER (p <> 'basedIn'), count(*) FILTER (p = 'basedIn') FROM e UNION ALL SELECT 'values', count(*), count(*), 0 FROM g WHERE o_kind = 'lit'",
    lambda t, k: gv.property_graph_check(t, an.lpg_nodes(t), an.lpg_rels(t.where("p <> 'basedIn'"), k["inverse"]), k["inverse"]),
)
on_graph(
    "lpg_graph_context", f" SELECT x.type, x.context, count(*) AS n FROM (SELECT p AS type, 'main' AS context FROM e UNION ALL SELECT i.q, 'inferred' FROM e JOIN (VALUES {INV}) AS i(p, q) USING (p)) x GROUP BY ALL",
    lambda t, k: gv.graph_context(
        rs.inverse_complete(t, k["inverse"]).where("o_kind = 'iri' and p <> 'type'").select(F.col("s").alias("start"), F.col("o").alias("end"), F.col("p").alias("type")),
        t.where("o_kind = 'iri' and p <> 'type'").select(F.col("s").alias("start"), F.col("o").alias("end"), F.col("p").alias("type")),
    ).groupBy("type", "context").agg(F.count("*").alias("n")),
)
on_graph(
    "origin_summary", f" SELECT 'cwa' AS category, count(*) AS n FROM g UNION ALL SELECT 'inferred', count(*) FROM (SELECT s, c FROM g JOIN {DOM} USING (p) UNION SELECT o, c FROM e JOIN {RAN} USING (p))",
    lambda t, k: gv.origin_summary(gv.tagged_origin(t, "csv_direct").select("origin").unionByName(gv.tagged_origin(rs.one_step(t, t, {x: k[x] for x in ("domain", "range")}), "owl_rl_1hop").select("origin"))),
)
on_graph(
    "metric_triples", ", m AS (SELECT 'run/measurement/' || p AS s, p, count(*) AS n FROM g GROUP BY p) SELECT s, 'type' AS p, 'QualityMeasurement' AS o FROM m UNION ALL SELECT s, 'computedOn', 'run' FROM m UNION ALL SELECT s, 'isMeasurementOf', p FROM m UNION ALL SELECT s, 'value', n::VARCHAR FROM m",
    lambda t, _: gv.measurements(t.groupBy(F.col("p").alias("metric")).agg(F.count("*").alias("value")), "run"),
)

# --- questions and history ----------------------------------------------------------------------------------------------------------

ASKED = [("Order", "Customer"), ("Customer", "Order"), ("Order", "Nation"), ("Customer", "Supplier"), ("Order", "Region"), ("Part", "Nation"), ("Region", "Region")]
ASKED_SQL = f"(VALUES {_values(ASKED)}) AS q(source, target)"
STAGES = f"""{LINKS}, n AS (SELECT DISTINCT m, c FROM (SELECT e.s AS m, ty.c FROM e JOIN ty ON ty.node = e.o UNION ALL SELECT e.o, ty.c FROM e JOIN ty ON ty.node = e.s)), h AS (SELECT DISTINCT a.c, b.c AS d FROM n a JOIN n b USING (m)),
st AS (SELECT source, target, CASE WHEN (source, target) IN (SELECT d, r FROM l) THEN 1 WHEN (source, target) IN (SELECT r, d FROM l) THEN 2 WHEN (source, target) IN (SELECT c, d FROM h) THEN 3 END AS stage FROM {ASKED_SQL})"""


def _asked(t: DataFrame) -> DataFrame:
    return _local(t, ASKED, "source string, target string")


on_graph("linked_classes", f"{STAGES} SELECT source, target, stage FROM st", lambda t, _: ev.linked_classes(t, _asked(t)))
CLASS_LINKS = [(d, r) for _, d, r in sg.OBJECT_PROPERTIES]
on_graph(
    "class_paths",
    f", x AS (SELECT a, b FROM (VALUES {_values(CLASS_LINKS)}) AS x(a, b) UNION SELECT b, a FROM (VALUES {_values(CLASS_LINKS)}) AS x(a, b)), w AS (SELECT source, source AS node, 0 AS h FROM {ASKED_SQL} UNION SELECT w.source, x.b, h + 1 FROM w JOIN x ON x.a = w.node WHERE h < 3) SELECT source, target, min(h) AS hops FROM {ASKED_SQL} JOIN w USING (source) WHERE node = target GROUP BY ALL",
    lambda t, _: ev.class_paths(_local(t, CLASS_LINKS, "domain string, range string"), _asked(t)),
)
on_graph(
    "competency_coverage",
    f"{STAGES} SELECT source || '-' || target AS q, source <> 'Part' AS in_schema, source <> 'Supplier' AND target <> 'Supplier' AND stage IS NOT NULL AS in_graph, stage IS NOT NULL AS in_inferred FROM st",
    lambda t, k: ev.competency_coverage(_asked(t).withColumn("q", F.concat_ws("-", "source", "target")), _local(t, CLASS_LINKS, "domain string, range string"), t.where("s not like 'Supplier%'"), t),
)


def _golden(t: DataFrame, _: dict[str, DataFrame]) -> DataFrame:
    regions, none = gr.match(t, "?x", "type", "Region"), gr.match(t, "?x", "ghost", "?y")
    text = "SELECT ?x WHERE { ?x a :Region }"
    cases = [
        ev.golden_case("bounds", regions, 1, 10, ["x"], ["Region"], ["SERVICE"], text), ev.golden_case("few", none, 1), ev.golden_case("many", regions, 0, 2),
        ev.golden_case("variables", regions, 0, None, ["y"]), ev.golden_case("empty_variables", none, 0, None, ["z"]), ev.golden_case("tokens", regions, 0, None, [], ["Nation"], ["SELECT"], text),
    ]
    out = cases[0]
    for c in cases[1:]:
        out = out.unionByName(c)
    return out


on_graph(
    "golden_cases", ", r AS (SELECT count(*) AS n FROM ty WHERE c = 'Region') SELECT k AS \"case\", CASE WHEN k IN ('few', 'empty_variables') THEN 0 ELSE n END AS n_rows, CASE WHEN f = '' THEN 'pass' ELSE 'fail' END AS status, f AS failures FROM r, "
    "(VALUES ('bounds', ''), ('few', 'min_rows'), ('many', 'max_rows'), ('variables', 'required'), ('empty_variables', ''), ('tokens', 'tokens,banned')) AS c(k, f)",
    _golden,
)
CASES = [("a", "Nation_1", "type", "Nation", True), ("b", "Nation_1", "type", "Region", False), ("c", "Nation_1", "type", "Part", True), ("d", "Nation_2", "type", "Nation", False)]
on_graph(
    "entailment_cases", f" SELECT k AS \"case\", (s, p, o) IN (SELECT s, p, o FROM g) AS holds, ((s, p, o) IN (SELECT s, p, o FROM g)) = x AS passed FROM (VALUES {_values(CASES)}) AS c(k, s, p, o, x)",
    lambda t, _: ev.entailment_cases(t, _local(t, CASES, "case string, s string, p string, o string, expected boolean")),
)

ALERTS_SQL = """WITH h AS (SELECT 'S' || s_suppkey AS equipment, 'P' || s_nationkey % 4 AS pattern FROM supplier), t AS (SELECT 'S' || s_suppkey AS equipment, s_nationkey AS tag FROM supplier UNION SELECT 'S' || s_suppkey, s_suppkey % 50 FROM supplier),
a AS (SELECT event_id, user_id % 50 AS tag, CASE WHEN event_id % 50 <> 0 THEN ts END AS ts FROM events WHERE event_type = 'error' AND user_id % 50 <> 7),
p AS (SELECT * FROM (VALUES ('P0', 5, 24, 'heat'), ('P1', 20, NULL, 'wear'), ('P2', 1, 96, 'leak'), ('P3', 0, 1000, 'noise'), ('P9', 1, 1, 'none')) AS p(pattern, threshold, hours, failure)),
n AS (SELECT equipment, pattern, failure, threshold, count(event_id) FILTER (hours IS NULL OR hours >= 720 OR ts IS NULL OR ts >= TIMESTAMP '2024-01-31 00:00:00' - to_hours(hours)) AS n_alarms
  FROM h JOIN p USING (pattern) LEFT JOIN t USING (equipment) LEFT JOIN a USING (tag) GROUP BY equipment, pattern, failure, threshold)
"""
PATTERNS = [("P0", 5, 24, "heat"), ("P1", 20, None, "wear"), ("P2", 1, 96, "leak"), ("P3", 0, 1000, "noise"), ("P9", 1, 1, "none")]


def _patterns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as equipment with a pattern by nation; and the patterns, of which one has no window, one is beyond the longest, and one is nobody's."""
    holders = table(spark, sf_dir, "supplier").selectExpr("concat('S', s_suppkey) as equipment", "concat('P', s_nationkey % 4) as pattern")
    return holders, inline(spark, PATTERNS, "pattern string, threshold long, hours int, failure string")


@query(f"{ALERTS_SQL} SELECT *, n_alarms >= threshold AS alert FROM n")
def failure_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equipment tagged by nation and number; errors as alarms, tagged by user, none with tag 7."""
    holders, patterns = _patterns(spark, sf_dir)
    supplier = table(spark, sf_dir, "supplier").selectExpr("concat('S', s_suppkey) as equipment", "s_nationkey as nation", "s_suppkey % 50 as number")
    tags = supplier.selectExpr("equipment", "cast(nation as long) as tag").union(supplier.selectExpr("equipment", "cast(number as long)"))
    errors = table(spark, sf_dir, "events").where("event_type = 'error' and user_id % 50 <> 7")
    alarms = errors.selectExpr("event_id as alarm", "cast(user_id % 50 as long) as tag", "CASE WHEN event_id % 50 <> 0 THEN ts END as ts")
    return ev.failure_alerts(holders, patterns, tags, alarms, "2024-01-31 00:00:00")


@query(f"{ALERTS_SQL} SELECT pattern, failure FROM p WHERE pattern NOT IN (SELECT pattern FROM h)")
def unassigned_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    holders, patterns = _patterns(spark, sf_dir)
    return ev.unassigned_patterns(patterns, holders).select("pattern", "failure")


def _parity(t: DataFrame, _: dict[str, DataFrame]) -> DataFrame:
    count = lambda df: df.groupBy(F.col("p").alias("metric")).agg(F.count("*").alias("value"))
    return ev.parity(count(t.where("p <> 'brand'")), count(t.where("not (p = 'status' and o = 'X') and not (p = 'type' and s like 'Order%') and p <> 'size'")))


on_graph(
    "store_parity", """, k AS (SELECT p AS metric, count(*) FILTER (p <> 'brand') AS a, count(*) FILTER (NOT (p = 'status' AND o = 'X') AND NOT (p = 'type' AND s LIKE 'Order%') AND p <> 'size') AS b FROM g GROUP BY p),
    n AS (SELECT metric, nullif(a, 0) AS a, nullif(b, 0) AS b FROM k), d AS (SELECT *, round(abs(a - b) * 100.0::DOUBLE / greatest(a, b), 2) AS d FROM n)
    SELECT metric, a, b, d AS differs_pct, CASE WHEN d IS NULL THEN 'insufficient' WHEN d = 0 THEN 'identical' WHEN d <= 5 THEN 'near_identical' ELSE 'divergent' END AS status FROM d""",
    _parity,
)


@query("""WITH r AS (SELECT event_id AS run, event_id % 7 + user_id % 5 AS passed, 10 + (user_id % 11 = 0)::INT AS total FROM events), b AS (SELECT *, lag(passed) OVER (ORDER BY run) AS had, lag(total) OVER (ORDER BY run) AS was FROM r)
SELECT run FROM b WHERE had IS NOT NULL AND CASE WHEN was = total THEN passed < had ELSE total - passed > was - had END""")
def run_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators import checks as ck

    return ck.run_regressions(table(spark, sf_dir, "events").selectExpr("event_id as run", "event_id % 7 + user_id % 5 as passed", "10 + cast(user_id % 11 = 0 as int) as total"))
