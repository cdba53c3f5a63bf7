"""The catalogue of queries over the driver's tables, each with the same rows in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import coercion as co
from graphloom.operators import analytics as an
from graphloom.operators import checks as ck
from graphloom.operators import dimensions as dm
from graphloom.operators import graph as gr
from graphloom.operators import profile as pr
from graphloom.operators import reasoning as rs
from graphloom.operators import rules as ru
from graphloom.operators import schema_lint as sl
from graphloom.plans import star_graph as sg
from graphloom.sources.tables import inline, table
from graphloom.storage import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
G = f"WITH RECURSIVE g AS ({sg.graph_sql()}), ty AS (SELECT s AS node, o AS c FROM g WHERE p = 'type'), e AS (SELECT s, p, o FROM g WHERE o_kind = 'iri' AND p <> 'type')"


def query(sql: str) -> Callable[[Query], Query]:
    """Register a function under its name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


#: Queries that read the graph several times; they share a stored one, whose tables are converted once, and their filters are pushed into it.
SEVERAL_READS = {
    "justify_rules", "classify_triples", "delta", "rl_fixpoint", "rl_domain_range", "inverse_complete", "lpg_inverse_dedup", "type_pollution", "check_range", "check_domain", "check_cardinality",
    "check_inference", "check_bidirectional", "check_report", "check_report_score", "check_numeric_outliers", "dict_numeric_stats", "check_prop_completeness", "check_relationship_outliers", "mutation_sensitivity", "sparql_bgp", "sparql_orders_per_nation", "class_links", "two_hop_paths", "graph_diff", "swrl_rule", "closure_transitive", "statement_ids", "merged_terms", "intersection_of",
    "quality_dimensions", "approx_diameter",
}


def on_graph(name: str, sql: str, plan: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]) -> None:
    """Register a plan over the graph's triples and its schema tables; sql follows the common table expressions g, ty and e."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        triples = (sg.kept_graph if name in SEVERAL_READS else sg.graph)(spark, sf_dir)
        return plan(triples, sg.schema_rows(spark))

    QUERIES[name] = run
    ORACLES[name] = f"{G}{sql}"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


# --- profiles, keys, foreign keys ---------------------------------------------------------------------------------------------------

HOLED = "CASE WHEN {k} % 97 = 0 THEN NULL ELSE {c} END"


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with holes at every 97th row."""
    df = table(spark, sf_dir, "orders")
    return df.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderstatus")))


PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
HOLED_SQL = f"(SELECT o_orderkey, o_custkey, {HOLED.format(k='o_orderkey', c='o_orderstatus')} AS o_orderstatus, o_orderpriority, o_totalprice, o_orderdate FROM orders)"


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, count({c}) = count(DISTINCT {c}) AND count(DISTINCT {c}) > 10 AS potential_pk FROM {HOLED_SQL}" for c in PROFILED))
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.profile(_holed(spark, sf_dir), PROFILED)


VALUE_TYPE = r"CASE WHEN lower(v) IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(v, '^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}') THEN 'dateTime' WHEN regexp_matches(v, '^[+-]?\d+$') THEN 'integer' WHEN regexp_matches(v, '^[+-]?\d*\.\d+([eE][+-]?\d+)?$') THEN 'decimal' ELSE 'string' END"


@query(f"""WITH cells AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, o_orderkey AS k, {c}::VARCHAR AS v FROM {HOLED_SQL}" for c in PROFILED)}),
first AS (SELECT c, {VALUE_TYPE} AS type, row_number() OVER (PARTITION BY c ORDER BY k) AS r FROM cells WHERE v <> ''),
counted AS (SELECT c, type, count(*) AS n, min(r) AS r FROM first WHERE r <= {pr.SAMPLE} GROUP BY c, type)
SELECT c AS "column", type, (count(*) OVER (PARTITION BY c)) > 1 AS mixed FROM counted QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, r) = 1""")
def profile_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.dominant_types(_holed(spark, sf_dir), PROFILED, ["o_orderkey"])


@query(f"SELECT round(100.0::DOUBLE - (count(*) - count(o_orderstatus)) * 100.0 / count(*) / 4, 6) AS score FROM {HOLED_SQL}")
def profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _holed(spark, sf_dir)
    return pr.quality_score(pr.profile(df, PROFILED), pr.dominant_types(df, PROFILED, ["o_orderkey"]))


@query("SELECT count(DISTINCT k) AS n_values, count(DISTINCT k) FILTER (c_custkey IS NULL) AS n_missing FROM (SELECT CASE WHEN o_orderkey % 97 = 0 THEN -o_orderkey ELSE o_custkey END AS k FROM orders) LEFT JOIN customer ON k = c_custkey")
def fk_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = table(spark, sf_dir, "orders").select(F.expr("CASE WHEN o_orderkey % 97 = 0 THEN -o_orderkey ELSE o_custkey END").alias("k"))
    return pr.fk_validity(child, "k", table(spark, sf_dir, "customer"), "c_custkey")


@query("""WITH k AS (SELECT DISTINCT l_suppkey AS k FROM lineitem), c AS (SELECT 'supplier' AS target, s_suppkey AS k FROM supplier UNION SELECT 'part', p_partkey FROM part UNION SELECT 'region', r_regionkey FROM region)
SELECT target, count(*) / (SELECT count(*) FROM k)::DOUBLE AS overlap FROM k JOIN c USING (k) GROUP BY target HAVING count(*) / (SELECT count(*) FROM k)::DOUBLE >= 0.8""")
def fk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.fk_overlap(table(spark, sf_dir, "lineitem"), "l_suppkey", {n: (table(spark, sf_dir, n), k) for n, k in (("supplier", "s_suppkey"), ("part", "p_partkey"), ("region", "r_regionkey"))})


@query("""WITH r AS (SELECT 'l_orderkey' AS "column", 0 AS place, count(DISTINCT l_orderkey) / count(*)::DOUBLE AS ratio FROM lineitem UNION ALL SELECT 'l_partkey', 1, count(DISTINCT l_partkey) / count(*)::DOUBLE FROM lineitem UNION ALL SELECT 'l_suppkey', 2, count(DISTINCT l_suppkey) / count(*)::DOUBLE FROM lineitem)
SELECT "column", ratio, row_number() OVER (ORDER BY ratio DESC, place)::INT AS rank FROM r""")
def pk_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.key_ranking(table(spark, sf_dir, "lineitem"), ("key",))


@query("""WITH n AS (SELECT count(DISTINCT l_orderkey) AS a, count(DISTINCT l_partkey) AS b, count(DISTINCT l_suppkey) AS c, count(DISTINCT (l_orderkey, l_partkey)) AS ab, count(DISTINCT (l_orderkey, l_suppkey)) AS ac, count(*) AS t FROM lineitem)
SELECT 'l_orderkey' AS "column", 0 AS place FROM n WHERE a > b AND a > c UNION ALL SELECT CASE WHEN ac >= ab THEN 'l_suppkey' ELSE 'l_partkey' END, 1 FROM n UNION ALL SELECT CASE WHEN ac >= ab THEN 'l_partkey' ELSE 'l_suppkey' END, 2 FROM n WHERE greatest(ab, ac) < t""")
def pk_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = pr.composite_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"])
    return inline(spark, [(c, i) for i, c in enumerate(key)], "column string, place int")


@query("SELECT 'Line_' || l_orderkey || '_' || l_linenumber AS iri, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def pk_duplicate_iris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "Line_")


PERTURBED = "CASE WHEN s_suppkey % 5 = 1 THEN lower(s_name) WHEN s_suppkey % 5 = 2 THEN replace(s_name, '#', '# ') WHEN s_suppkey % 5 = 3 THEN s_name || 'x' WHEN s_suppkey % 5 = 4 THEN substr(s_name, 1, 9) || s_suppkey ELSE s_name END"
LADDER = r"regexp_replace(lower(trim({x})), '[-_. –—]', '', 'g')"


@query(f"""WITH v AS (SELECT DISTINCT {PERTURBED} AS value FROM supplier), n AS (SELECT value, {LADDER.format(x="value")} AS norm FROM v), m AS (SELECT DISTINCT s_name AS k, {LADDER.format(x="s_name")} AS norm FROM supplier),
c AS (SELECT value, k, 1 AS stage FROM n JOIN m ON value = k UNION ALL SELECT value, k, 2 FROM n JOIN m ON n.norm = m.norm UNION ALL SELECT value, k, 3 FROM n JOIN m ON levenshtein(n.norm, m.norm) <= 1),
b AS (SELECT value, k AS "match", stage FROM c QUALIFY row_number() OVER (PARTITION BY value ORDER BY stage, k) = 1)
SELECT value, "match", stage FROM v LEFT JOIN b USING (value)""")
def fk_ladder_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    return pr.fk_ladder(supplier.select(F.expr(PERTURBED).alias("value")), "value", supplier, "s_name", prefix=False)


@query(f"""WITH v AS (SELECT DISTINCT {PERTURBED} AS value FROM supplier), n AS (SELECT value, {LADDER.format(x="value")} AS norm FROM v), m AS (SELECT DISTINCT s_name AS k, {LADDER.format(x="s_name")} AS norm FROM supplier),
c AS (SELECT value, k, 1 AS stage FROM n JOIN m ON value = k UNION ALL SELECT value, k, 2 FROM n JOIN m ON n.norm = m.norm),
b AS (SELECT value, k AS "match", stage FROM c QUALIFY row_number() OVER (PARTITION BY value ORDER BY stage, k) = 1)
SELECT value, "match", stage FROM v LEFT JOIN b USING (value)""")
def fk_ladder_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    return pr.fk_ladder(supplier.select(F.expr(PERTURBED).alias("value")), "value", supplier, "s_name", edit=False, prefix=False)


@query(f"""WITH v AS (SELECT DISTINCT substr(s_name, 1, length(s_name) - 1) AS value FROM supplier), n AS (SELECT value, {LADDER.format(x="value")} AS norm FROM v), m AS (SELECT DISTINCT s_name AS k, {LADDER.format(x="s_name")} AS norm FROM supplier),
p AS (SELECT value, min(k) AS k, 4 AS stage FROM n JOIN m ON starts_with(m.norm, n.norm) AND length(n.norm) < length(m.norm) AND length(n.norm) >= 3 GROUP BY value HAVING count(DISTINCT m.norm) = 1)
SELECT value, k AS "match", stage FROM v LEFT JOIN p USING (value)""")
def fk_ladder_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    return pr.fk_ladder(supplier.select(F.expr("substr(s_name, 1, length(s_name) - 1)").alias("value")), "value", supplier, "s_name", edit=False)


# --- coercion -----------------------------------------------------------------------------------------------------------------------

#: Every seventeenth event has the same spelling; ten of them stand for a missing value.
SPELLINGS = [" N/A ", "na", "NULL", "-", "None", "#n/a", "NaN", " undefined", "미정", "해당없음", "", "  ", "nano", "--", "n / a"]
MESSY = "CASE event_id % 17 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(SPELLINGS)) + " WHEN 15 THEN ' ' || event_type ELSE event_type END"
MISSING = "('n/a', 'na', 'null', '-', 'none', '#n/a', 'nan', 'undefined', '미정', '해당없음')"


@query(f"SELECT v AS value, count(*) AS n FROM (SELECT CASE WHEN trim(x) <> '' AND lower(trim(x)) NOT IN {MISSING} THEN trim(x) END AS v FROM (SELECT {MESSY} AS x FROM events)) GROUP BY v")
def null_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(co.without_sentinel(F.expr(MESSY)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


SIGNS = {"sign": "CASE event_id % 4 WHEN 0 THEN '-' WHEN 1 THEN '+' WHEN 2 THEN ' 0' ELSE '' END", "messy": MESSY, "plain": "event_type"}


@query(f"""WITH cells AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, trim({x}) AS v FROM events" for c, x in SIGNS.items())}),
k AS (SELECT c, count(DISTINCT v) AS d, bool_or(v = '-') AND count(DISTINCT v) <= 4 AS keeps FROM cells WHERE v <> '' GROUP BY c)
SELECT c AS "column", CASE WHEN v <> '' AND (lower(v) NOT IN {MISSING} OR (v = '-' AND keeps)) THEN v END AS value, d AS n_distinct, count(*) AS n FROM cells JOIN k USING (c) GROUP BY 1, 2, 3""")
def dash_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned values of three columns, of which the one of signs holds - as data."""
    df = table(spark, sf_dir, "events").select(*[F.expr(x).alias(c) for c, x in SIGNS.items()])
    found = co.dash_columns(df, list(SIGNS))
    keeps = {r["column"] for r in found.where("keeps_dash").collect()}  # a row a column
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), co.without_sentinel(F.col(c), c in keeps).alias("value")) for c in SIGNS]))
    return df.select(cells.alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n")).join(found.select("column", "n_distinct"), "column")


SYNONYMS = [("F", "finished"), ("O", "open"), ("P", "pending")]
LOOSE = "CASE WHEN o_orderkey % 3 = 0 THEN '  ' || o_orderstatus WHEN o_orderkey % 3 = 1 THEN o_orderstatus || ' ' WHEN o_orderkey % 101 = 2 THEN NULL ELSE o_orderstatus END"


@query(f"SELECT coalesce(canon, v) AS status, canon IS NULL AND v IS NOT NULL AS unknown, count(*) AS n FROM (SELECT trim({LOOSE}) AS v FROM orders) LEFT JOIN (VALUES {_values(SYNONYMS[:2])}) AS m(alias, canon) ON alias = v GROUP BY 1, 2")
def enum_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = inline(spark, SYNONYMS[:2], "alias string, canon string")
    done = co.canonical(table(spark, sf_dir, "orders").select(F.expr(LOOSE).alias("status")), "status", names)
    return done.groupBy(F.col("value").alias("status"), "unknown").agg(F.count("*").alias("n"))


@query(r"SELECT p_partkey, regexp_replace(p_name || ' / ' || p_brand, '[^\p{L}\p{M}\p{N}_-]', '_', 'g') AS part_name, regexp_replace(p_name || ' / ' || p_brand, '[^\p{L}\p{M}\p{N}_-]+', '_', 'g') AS iri_name FROM part")
def safe_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" / "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", co.safe_local(name).alias("part_name"), co.safe_iri(name).alias("iri_name"))


@query("SELECT o_orderkey, CASE WHEN day(o_orderdate) > 12 OR o_orderkey % 2 = 0 THEN o_orderdate::DATE::TIMESTAMP END AS read FROM orders")
def date_order_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even rows are written yyyy-MM-dd, odd ones dd/MM/yyyy, which only reads if the day is over 12."""
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", co.to_timestamp(text).alias("read"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE trunc(value) END::BIGINT AS whole, event_id % 3 <> 0 AS is_number FROM events")
def typed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, F.lit("12x")).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), F.col("value").cast("string"))).otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", co.to_integer(text).alias("whole"), co.to_number(text).isNotNull().alias("is_number"))


# --- rules --------------------------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer), t AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS j FROM supplier)
SELECT c_custkey AS s, s_suppkey AS o FROM s JOIN t ON i % (SELECT count(*) FROM supplier) = j WHERE c_mktsegment = 'BUILDING'""")
def rule_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.rotation(table(spark, sf_dir, "customer"), F.col("c_custkey"), ["c_custkey"], table(spark, sf_dir, "supplier"), F.col("s_suppkey"), ["s_suppkey"], F.col("c_mktsegment") == "BUILDING")


@query("SELECT s_suppkey AS s, 'EQ' || CASE WHEN length(n) < 3 THEN lpad(n, 3, '0') ELSE n END AS o FROM (SELECT s_suppkey, regexp_extract(s_name, '([0-9]+)$', 1)::BIGINT::VARCHAR AS n FROM supplier)")
def rule_number_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.number_match(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), F.col("s_name"), "EQ%03d")


@query("SELECT o_orderkey AS s, 'Customer_' || o_custkey AS o FROM orders WHERE o_orderstatus = 'F'")
def rule_simple_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.simple_join(table(spark, sf_dir, "orders"), F.col("o_orderkey"), "o_custkey", "Customer_", F.col("o_orderstatus") == "F")


FIRST_ORDER = "(SELECT o_custkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)"


@query(f"SELECT c_custkey AS s, o_orderpriority AS o FROM customer JOIN {FIRST_ORDER} ON c_custkey = o_custkey")
def rule_fk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.fk_lookup(table(spark, sf_dir, "customer"), F.col("c_custkey"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", ["o_orderkey"])


@query("SELECT c_custkey AS s, n_regionkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def rule_via_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    upstream = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s"), F.col("c_nationkey").alias("o"))
    return ru.via_chain(upstream, table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey", ["n_nationkey"])


@query("SELECT s_suppkey AS s, c_custkey AS o FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def rule_bucket_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.bucket_join(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), F.col("s_nationkey"), table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_nationkey"))


@query("""WITH s AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part), t AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS j FROM nation)
SELECT p_partkey, n_nationkey AS origin FROM s JOIN t ON i % 25 = j""")
def fk_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.with_synthetic_fk(table(spark, sf_dir, "part").select("p_partkey"), "origin", ["p_partkey"], table(spark, sf_dir, "nation"), "n_nationkey", ["n_nationkey"])


# --- triples and patterns -----------------------------------------------------------------------------------------------------------

on_graph("triples_literals", " SELECT s, p, o FROM g WHERE o_kind = 'lit'", lambda t, _: t.where("o_kind = 'lit'").select("s", "p", "o"))
on_graph("triples_edges", " SELECT s, p, o FROM e", lambda t, _: t.where("o_kind = 'iri' and p <> 'type'").select("s", "p", "o"))
INV = _values(sg.INVERSES)
on_graph(
    "inverse_complete", f" SELECT s, p, o FROM g UNION SELECT e.o, i.q, e.s FROM e JOIN (VALUES {INV}) AS i(p, q) USING (p)",
    lambda t, k: rs.inverse_complete(t, k["inverse"]).select("s", "p", "o"),
)
on_graph(
    "sparql_orders_per_nation", " SELECT l.o AS nation, count(DISTINCT a.s) AS n FROM e a JOIN e b ON a.o = b.s JOIN g l ON b.o = l.s WHERE a.p = 'placedBy' AND b.p = 'inNation' AND l.p = 'nationName' GROUP BY l.o",
    lambda t, _: gr.join(gr.match(t, "?order", "type", "Order"), gr.match(t, "?order", "placedBy", "?c"), gr.match(t, "?c", "inNation", "?x"), gr.match(t, "?x", "nationName", "?nation")).groupBy("nation").agg(F.count_distinct("order").alias("n")),
)
on_graph(
    "sparql_bgp", " SELECT a.s AS c, b.o AS r FROM e a JOIN e b ON a.o = b.s WHERE a.p = 'inNation' AND b.p = 'inRegion'",
    lambda t, _: gr.join(gr.match(t, "?c", "inNation", "?n"), gr.match(t, "?n", "inRegion", "?r")).select("c", "r"),
)
on_graph(
    "sparql_optional", " SELECT t.node AS x, s.o AS status FROM ty t LEFT JOIN g s ON s.s = t.node AND s.p = 'status' AND s.o <> 'F' WHERE t.c = 'Order'",
    lambda t, _: gr.optional(gr.match(t, "?x", "type", "Order"), gr.match(t, "?x", "status", "?status"), F.col("status") != "F"),
)
on_graph(
    "sparql_union", " SELECT s AS x, o AS n, NULL AS segment FROM e WHERE p = 'basedIn' UNION ALL SELECT s, NULL, o FROM g WHERE p = 'segment'",
    lambda t, _: gr.union(gr.match(t, "?x", "basedIn", "?n"), gr.match(t, "?x", "segment", "?segment")),
)
on_graph(
    "sparql_not_exists", " SELECT node AS x FROM ty WHERE c = 'Order' AND NOT EXISTS (SELECT 1 FROM g WHERE g.s = node AND p = 'status')",
    lambda t, _: gr.not_exists(gr.match(t, "?x", "type", "Order"), gr.match(t, "?x", "status", "?v").select("x")),
)
on_graph(
    "sparql_exists", " SELECT node AS x FROM ty WHERE c = 'Customer' AND EXISTS (SELECT 1 FROM e WHERE e.o = node AND p = 'placedBy')",
    lambda t, _: gr.exists(gr.match(t, "?x", "type", "Customer"), gr.match(t, "?order", "placedBy", "?x").select("x")),
)
on_graph(
    "sparql_values", " SELECT s AS x, o AS name FROM g WHERE p = 'nationName' AND o IN (SELECT o FROM g WHERE p = 'nationName' AND s IN ('Nation_1', 'Nation_2')) AND s IN ('Nation_1', 'Nation_2', 'Nation_99')",
    lambda t, _: gr.values(gr.match(t, "?x", "nationName", "?name"), "x", ["Nation_1", "Nation_2", "Nation_99"]),
)
on_graph(
    "sparql_having", " SELECT o AS c, count(*) AS n FROM e WHERE p = 'placedBy' GROUP BY o HAVING count(*) > 12",
    lambda t, _: gr.match(t, "?x", "placedBy", "?c").groupBy("c").agg(F.count("*").alias("n")).where("n > 12"),
)
on_graph(
    "sparql_subagg", " SELECT n.o AS nation, coalesce(sum(k.n), 0)::BIGINT AS orders FROM e n LEFT JOIN (SELECT o AS c, count(*) AS n FROM e WHERE p = 'placedBy' GROUP BY o) k ON k.c = n.s WHERE n.p = 'inNation' GROUP BY n.o",
    lambda t, _: gr.optional(gr.match(t, "?c", "inNation", "?nation"), gr.match(t, "?x", "placedBy", "?c").groupBy("c").agg(F.count("*").alias("k"))).groupBy("nation").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("orders")),
)
on_graph(
    "sparql_path", ", step AS (SELECT s AS a, o AS b FROM e WHERE p IN ('inNation', 'inRegion')), pairs AS (SELECT a, b FROM step UNION SELECT p.a, s.b FROM pairs p JOIN step s ON p.b = s.a) SELECT a, b FROM pairs",
    lambda t, _: gr.path_plus(t.where("p in ('inNation', 'inRegion')").withColumn("p", F.lit("within")), "within", "a", "b"),
)
on_graph(
    "sparql_order_limit", " SELECT s AS x, o_num AS total FROM g WHERE p = 'total' ORDER BY o_num DESC, s LIMIT 20",
    lambda t, _: gr.match(t, "?x", "total", "?text", number="total").orderBy(F.desc("total"), "x").limit(20).select("x", "total"),
)
on_graph(
    "sparql_filter_bind", " SELECT s AS x, CASE WHEN o_num > 200000 THEN 'large' ELSE 'small' END AS band FROM g WHERE p = 'total' AND o_num > 100000",
    lambda t, _: gr.match(t, "?x", "total", "?text", number="v").where("v > 100000").select("x", F.when(F.col("v") > 200000, "large").otherwise("small").alias("band")),
)
on_graph(
    "sparql_construct", " SELECT DISTINCT b.o AS s, 'hasCustomer' AS p, a.s AS o FROM e a JOIN e b ON a.o = b.s WHERE a.p = 'inNation' AND b.p = 'inRegion' UNION SELECT a.s, 'inPlace', b.o FROM e a JOIN e b ON a.o = b.s WHERE a.p = 'inNation' AND b.p = 'inRegion'",
    lambda t, _: gr.construct(gr.join(gr.match(t, "?c", "inNation", "?n"), gr.match(t, "?n", "inRegion", "?r")), ("?r", "hasCustomer", "?c"), ("?c", "inPlace", "?r")),
)
on_graph("sparql_ask", " SELECT count(*) > 0 AS answer FROM e WHERE p = 'placedBy' AND o = 'Customer_1'", lambda t, _: gr.match(t, "?x", "placedBy", "Customer_1").agg((F.count("*") > 0).alias("answer")))
on_graph(
    "sparql_update", " SELECT s, 'state' AS p, o FROM g WHERE p = 'status' UNION SELECT s, p, o FROM g WHERE p <> 'status'",
    lambda t, _: gr.insert(gr.delete(t.select("s", "p", "o"), t.where("p = 'status'")), t.where("p = 'status'").select("s", F.lit("state").alias("p"), "o")),
)
on_graph("class_distribution", " SELECT c, count(*) AS n FROM ty GROUP BY c", lambda t, _: t.where("p = 'type'").groupBy(F.col("o").alias("c")).agg(F.count("*").alias("n")))
on_graph("property_usage", " SELECT p, count(*) AS n, count(DISTINCT s) AS subjects FROM g GROUP BY p", lambda t, _: t.groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects")))
on_graph(
    "entity_neighbourhood", " SELECT 'out' AS way, p, o AS other FROM e WHERE s = 'Nation_3' UNION ALL SELECT 'in', p, s FROM e WHERE o = 'Nation_3'",
    lambda t, _: gr.match(t, "Nation_3", "?p", "?other").where("p not in ('type', 'nationName')").withColumn("way", F.lit("out")).unionByName(gr.match(t, "?other", "?p", "Nation_3").withColumn("way", F.lit("in"))),
)

# --- reasoning ----------------------------------------------------------------------------------------------------------------------

SUB = f"(VALUES {_values(sg.SUBCLASSES)}) AS sub(a, b)"
DOM = f"(VALUES {_values([(p, d) for p, d, _ in sg.OBJECT_PROPERTIES] + sg.DATA_PROPERTIES)}) AS dom(p, c)"
RAN = f"(VALUES {_values([(p, r) for p, _, r in sg.OBJECT_PROPERTIES])}) AS ran(p, c)"
UP = f", up AS (SELECT a, b FROM {SUB} UNION SELECT u.a, s.b FROM up u JOIN {SUB.replace('AS sub', 'AS s')} ON u.b = s.a)"
CLOSED = f"{UP}, closed AS (SELECT node, c FROM ty UNION SELECT node, b FROM ty JOIN up ON c = a)"
CHAIN = [("inNation", "inRegion", "inRegionOf")]

on_graph("closure_subclass", f"{UP} SELECT a, b FROM up", lambda t, k: rs.superclasses(k["subclass"]))
on_graph(
    "closure_transitive", ", step AS (SELECT s AS a, o AS b FROM e), pairs AS (SELECT a, b FROM step UNION SELECT p.a, s.b FROM pairs p JOIN step s ON p.b = s.a) SELECT a, b FROM pairs",
    lambda t, _: gr.transitive(t.where("o_kind = 'iri' and p <> 'type'").select(F.col("s").alias("a"), F.col("o").alias("b"))),
)
ENTAILED = f"""{UP}, b AS (SELECT s, p, o FROM g UNION SELECT e.o, i.q, e.s FROM e JOIN (VALUES {INV}) AS i(p, q) USING (p)),
    d AS (SELECT s, p, o FROM b UNION SELECT s, 'type', c FROM b JOIN {DOM} USING (p) UNION SELECT e.o, 'type', c FROM e JOIN {RAN} USING (p)),
    f AS (SELECT s, p, o FROM d UNION SELECT s, 'type', up.b FROM d JOIN up ON d.p = 'type' AND d.o = up.a UNION SELECT x.s, 'inRegionOf', y.o FROM e x JOIN e y ON x.o = y.s WHERE x.p = 'inNation' AND y.p = 'inRegion')"""


def _entailed(t: DataFrame, k: dict[str, DataFrame], kept: bool = False) -> DataFrame:
    chain = inline(t.sparkSession, CHAIN, "p string, q string, r string")
    return rs.fixpoint(t, k | {"chain": chain}, kept)


on_graph("rl_fixpoint", f"{ENTAILED} SELECT s, p, o FROM f", lambda t, k: _entailed(t, k, True).select("s", "p", "o"))
on_graph("rl_domain_range", f" SELECT s, c FROM g JOIN {DOM} USING (p) UNION SELECT o, c FROM e JOIN {RAN} USING (p)", lambda t, k: rs.one_step(t, t, {x: k[x] for x in ("domain", "range")}).select("s", F.col("o").alias("c")).distinct())
on_graph(
    "rl_chain", " SELECT DISTINCT x.s, y.o FROM e x JOIN e y ON x.o = y.s WHERE x.p = 'inNation' AND y.p = 'inRegion'",
    lambda t, _: rs.one_step(t, t, {"chain": inline(t.sparkSession, CHAIN, "p string, q string, r string")}).select("s", "o"),
)
on_graph("restriction_has_value", " SELECT DISTINCT s, 'Building' AS c FROM g WHERE p = 'segment' AND o = 'BUILDING'", lambda t, _: rs.has_value(t, "segment", "BUILDING", "Building"))
on_graph("restriction_some", " SELECT DISTINCT s, 'Placed' AS c FROM e WHERE p = 'placedBy' AND o IN (SELECT node FROM ty WHERE c = 'Customer')", lambda t, _: rs.some_values(t, "placedBy", "Customer", "Placed"))
on_graph("restriction_all", " SELECT DISTINCT s, 'Pure' AS c FROM e WHERE p = 'placedBy' AND s NOT IN (SELECT s FROM e WHERE p = 'placedBy' AND o NOT IN (SELECT node FROM ty WHERE c = 'Customer'))", lambda t, _: rs.all_values(t, "placedBy", "Customer", "Pure"))
on_graph("restriction_min", " SELECT s, 'Double' AS c FROM g WHERE p = 'status' GROUP BY s HAVING count(DISTINCT o) >= 2", lambda t, _: rs.min_cardinality(t, "status", 2, "Double"))
NOISE = "CASE WHEN s LIKE '%7' AND p = 'inNation' THEN 'lit' WHEN s LIKE '%5' AND p = 'status' THEN 'iri' ELSE o_kind END"
on_graph(
    "prune_noise", f" SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p = 'inNation' AND k = 'lit' THEN 'literal_on_object_property' WHEN p = 'status' AND k = 'iri' THEN 'iri_on_data_property' ELSE 'keep' END AS reason FROM (SELECT p, {NOISE} AS k FROM g)) GROUP BY reason",
    lambda t, _: rs.prune_noise(t.withColumn("o_kind", F.expr(NOISE)), ["status"], ["inNation"]).groupBy("reason").agg(F.count("*").alias("n")),
)
on_graph(
    "type_pollution", " SELECT s, 'Place' AS new, 'Customer' AS old FROM (SELECT DISTINCT s FROM e WHERE p = 'inNation' AND s LIKE '%3')",
    lambda t, _: rs.type_pollution(t, t.where("p = 'inNation' and s like '%3'").select("s", F.lit("type").alias("p"), F.lit("Place").alias("o")), inline(t.sparkSession, [("Customer", "Place"), ("Order", "Place")], "a string, b string")),
)
on_graph(
    "justify_rules", f"{UP}, d AS (SELECT s, c AS o FROM g JOIN {DOM} USING (p)), r AS (SELECT o AS s, c AS o FROM e JOIN {RAN} USING (p)), b AS (SELECT node AS s, b AS o FROM ty JOIN {SUB} ON c = a), a AS (SELECT s, o FROM d UNION SELECT s, o FROM r UNION SELECT s, o FROM b UNION SELECT node, 'Agent' FROM ty) "
    "SELECT rule, count(*) AS n FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM ty WHERE node = a.s AND c = a.o) THEN 'already_exists' WHEN (a.s, a.o) IN (SELECT s, o FROM d) THEN 'domain' WHEN (a.s, a.o) IN (SELECT s, o FROM r) THEN 'range' WHEN (a.s, a.o) IN (SELECT s, o FROM b) THEN 'subclass' ELSE 'unknown' END AS rule FROM a) GROUP BY rule",
    lambda t, k: rs.justify(gr.insert(rs.one_step(t, t, {x: k[x] for x in ("domain", "range", "subclass")}).select("s", "p", "o"), t.where("p = 'type'").select("s", "p", F.lit("Agent").alias("o"))), t, k).groupBy("rule").agg(F.count("*").alias("n")),
)
on_graph(
    "classify_triples", f"{ENTAILED} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN s = o OR (p = 'type' AND o = 'Agent') THEN 'trivial' WHEN p = 'type' AND o NOT IN ('Party', 'Customer') THEN 'suspicious' ELSE 'meaningful' END AS kind FROM f WHERE (s, p, o) NOT IN (SELECT s, p, o FROM g)) GROUP BY kind",
    lambda t, k: rs.classified(rs.delta(_entailed(t, k, True), t), ["Agent"], ["Party", "Customer"]).groupBy("kind").agg(F.count("*").alias("n")),
)
on_graph("delta", f"{ENTAILED} SELECT p, count(*) AS n FROM f WHERE (s, p, o) NOT IN (SELECT s, p, o FROM g) GROUP BY p", lambda t, k: rs.delta(_entailed(t, k, True), t).groupBy("p").agg(F.count("*").alias("n")))
on_graph(
    "explosion_risk", " SELECT transitive_pct, symmetric_pct, CASE WHEN transitive_pct > 10 THEN 'HIGH' WHEN transitive_pct > 2 OR symmetric_pct > 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM (SELECT count(*) FILTER (p = 'inRegion') * 100.0 / count(*) AS transitive_pct, count(*) FILTER (p = 'placedBy') * 100.0 / count(*) AS symmetric_pct FROM g)",
    lambda t, _: rs.explosion_risk(t, ["inRegion"], ["placedBy"]),
)
on_graph(
    "swrl_rule", " SELECT DISTINCT a.s, 'competesWith' AS p, b.s AS o FROM e a JOIN e b ON a.o = b.o AND a.s <> b.s JOIN g x ON x.s = a.s AND x.p = 'supplierBalance' AND x.o_num > 5000 WHERE a.p = 'basedIn' AND b.p = 'basedIn'",
    lambda t, _: rs.rule_body(gr.match(t, "?a", "basedIn", "?n"), gr.match(t, "?a", "supplierBalance", "?v", number="x").where("x > 5000"), gr.match(t, "?b", "basedIn", "?n"), where=F.col("a") != F.col("b"), head=("?a", "competesWith", "?b"), on_head=True),
)
on_graph(
    "same_as", " SELECT a, b FROM (SELECT DISTINCT min(s) OVER (PARTITION BY o) AS a, s AS b FROM e WHERE p = 'inRegion') WHERE a < b",
    lambda t, _: rs.same_as(t.where("p = 'inRegion'").select(F.col("o").alias("s"), F.lit("onlyNation").alias("p"), F.col("s").alias("o"), "o_kind"), ["onlyNation"]),
)
on_graph(
    "has_key", " SELECT DISTINCT a, s AS b FROM (SELECT x.s, min(x.s) OVER (PARTITION BY y.o, z.o) AS a FROM g x JOIN g y ON y.s = x.s AND y.p = 'brand' JOIN g z ON z.s = x.s AND z.p = 'size' WHERE x.p = 'type' AND x.o = 'Part') WHERE a < s",
    lambda t, _: rs.has_key(t, "Part", ["brand", "size"]),
)
on_graph(
    "merged_terms", ", m AS (SELECT s, min(s) OVER (PARTITION BY o) AS least FROM e WHERE p = 'inRegion') SELECT DISTINCT coalesce(a.least, g.s) AS s, p, coalesce(b.least, g.o) AS o FROM g LEFT JOIN m a ON a.s = g.s LEFT JOIN m b ON b.s = g.o AND g.o_kind = 'iri'",
    lambda t, _: rs.merged_terms(t, rs.same_as(t.where("p = 'inRegion'").select(F.col("o").alias("s"), F.lit("onlyNation").alias("p"), F.col("s").alias("o"), "o_kind"), ["onlyNation"])).select("s", "p", "o"),
)
on_graph("union_of", " SELECT DISTINCT node AS s, 'Trader' AS c FROM ty WHERE c IN ('Customer', 'Supplier')", lambda t, _: rs.union_of(t, "Trader", ["Customer", "Supplier"]))
on_graph(
    "intersection_of", " SELECT DISTINCT s, 'RichParty' AS c FROM g WHERE p = 'balance' AND o_num > 5000",
    lambda t, _: rs.intersection_of(t.select("s", "p", "o").union(t.where("p = 'balance' AND o_num > 5000").select("s", F.lit("type"), F.lit("Rich"))), "RichParty", ["Customer", "Rich"]),
)


LINT_FOUND = [
    ("missing_label", "Ghost"), ("duplicate_label", "part"), ("class_naming", "old_class"), ("property_naming", "HasPart"), ("missing_domain_range", "loose"), ("multiple_domain_range", "inNation"), ("isolated_class", "Ghost"),
    ("self_subclass", "Loop"), ("subclass_cycle", "A"), ("subclass_cycle", "B"), ("subproperty_cycle", "p1"), ("subproperty_cycle", "p2"), ("self_inverse", "inNation"), ("transitive_self_loop", "placedBy"), ("deprecated_reference", "HasPart"), ("siblings_not_disjoint", "Customer"),
]


@query(f"SELECT rule, subject FROM (VALUES {_values(LINT_FOUND)}) AS x(rule, subject)")
def schema_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small schema with one violation of each rule or more; it doesn't depend on the tables."""
    own = lambda rows, names: inline(spark, rows, names)
    classes = own([("Customer", "customer", False), ("Supplier", "supplier", False), ("Party", "party", False), ("Nation", "nation", False), ("Ghost", None, False), ("old_class", "old", True), ("Part", "part", False)], "c string, label string, deprecated boolean")
    properties = own([("inNation", "Customer", "Nation", "in nation"), ("inNation", "Supplier", "Nation", "in nation"), ("HasPart", "old_class", "Part", "part"), ("loose", "Party", None, "loose"), ("placedBy", "Party", "Customer", "placed by")], "p string, domain string, range string, label string")
    pairs = lambda *rows: own(list(rows), "a string, b string")
    return sl.lint(
        classes, properties, pairs(("Customer", "Party"), ("Supplier", "Party"), ("Loop", "Loop"), ("A", "B"), ("B", "A")), pairs(("p1", "p2"), ("p2", "p1")),
        own([("inNation", "inNation"), ("x", "y")], "p string, q string"), own([("placedBy",)], "p string"), pairs(("Part", "Nation")),
    )

AXIOMS_FOUND = [
    ("circular_property", "partOf"), ("disjoint_style", "Part"), ("self_referencing_restriction", "Customer"), ("asymmetric_annotation", "Nation"), ("equivalent_class_cycle", "Customer"), ("equivalent_class_cycle", "Part"), ("disjoint_presence", "groups missing: 3"),
]


@query(f"SELECT rule, subject FROM (VALUES {_values(AXIOMS_FOUND)}) AS x(rule, subject)")
def schema_lint_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small schema with one violation of each rule among axioms; it doesn't depend on the tables."""
    own = lambda rows, names: inline(spark, rows, names)
    classes = own([("Customer", "customer", "buys"), ("Part", "part", "is sold"), ("Nation", "nation", None)], "c string, label string, comment string")
    properties = own([("segment", "Customer"), ("size", "Part")], "p string, domain string")
    wanted = own([(g, c) for g in ("x", "y", "z") for c in ("Customer", "Part")] + [("w", "Customer"), ("w", "Ghost")], "g string, c string")
    return sl.lint_axioms(
        classes, properties, own([("partOf", "hasPart")], "p string, q string"), own([("partOf",), ("near",)], "p string"), own([("Customer", "segment"), ("Customer", "size")], "c string, p string"),
        own([("Customer", "Part"), ("Part", "Customer"), ("Nation", "Nation")], "a string, b string"), own([("Part", "Nation")], "a string, b string"), own([], "g string, c string"), wanted,
    )


@query(f"""
WITH c(c) AS (VALUES {_values([(c,) for c in sorted({x for pair in sg.SUBCLASSES for x in pair} | {"Part"})])}), b(a, b) AS (VALUES {_values(sg.SUBCLASSES)}),
d(p, c) AS (VALUES {_values(sg.DATA_PROPERTIES)}), o(p, d, r) AS (VALUES {_values(sg.OBJECT_PROPERTIES)}),
k AS (SELECT c, (SELECT count(*) FROM b WHERE b.b = c.c) AS children, (SELECT count(*) FROM b WHERE b.a = c.c) AS parents, (SELECT count(*) FROM d WHERE d.c = c.c) AS n_data FROM c)
SELECT 'inheritance_depth' AS metric, 2.0::DOUBLE AS value UNION ALL SELECT 'children_mean', round(avg(children), 6) FROM k UNION ALL SELECT 'children_most', max(children)::DOUBLE FROM k
UNION ALL SELECT 'relationship_richness', round((SELECT count(DISTINCT p) FROM o) / ((SELECT count(DISTINCT p) FROM o) + (SELECT count(DISTINCT p) FROM d))::DOUBLE, 6)
UNION ALL SELECT 'attribute_richness', round(sum(n_data) / (count(*) FILTER (n_data > 0))::DOUBLE, 6) FROM k UNION ALL SELECT 'annotation', 0.5::DOUBLE
UNION ALL SELECT 'multi_parent_share', round((count(*) FILTER (parents > 1)) / count(*)::DOUBLE, 6) FROM k""")
def schema_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the mapping's schema, in which half of the terms are given a comment."""
    classes = sorted({x for pair in sg.SUBCLASSES for x in pair} | {"Part"})
    terms = [("c", c, None) for c in classes] + [("o", p, None) for p, _, _ in sg.OBJECT_PROPERTIES] + [("d", p, c) for p, c in sg.DATA_PROPERTIES]
    told = [(kind, t, d, t, t if k < len(terms) // 2 else None) for k, (kind, t, d) in enumerate(terms)]
    of = lambda kind: inline(spark, [r[1:] for r in told if r[0] == kind], "p string, domain string, label string, comment string")
    return sl.schema_metrics(of("c").select(F.col("p").alias("c"), "label", "comment"), inline(spark, sg.SUBCLASSES, "a string, b string"), of("o"), of("d"))


# --- checks -------------------------------------------------------------------------------------------------------------------------


#: The checks' names with their SQL (which follows G) and plan, for the report over all of them.
CHECKS: dict[str, tuple[str, Callable[[DataFrame, dict[str, DataFrame]], DataFrame]]] = {}


def check(name: str, body: str, plan: Callable[[DataFrame, dict[str, DataFrame]], DataFrame], label: str = "", allowed: float = 0.0, tables: str = "") -> None:
    """Register a check whose oracle's body yields the rows checked, with a boolean bad; tables are common table expressions before it."""
    counted = "count(*) > 0 AS applicable, count(*) AS n_checked, count(*) FILTER (bad) AS n_bad"
    sql = f"{tables} SELECT '{label or name}' AS \"check\", {counted}, count(*) FILTER (bad) <= count(*) * {allowed} AS passed FROM ({body})"
    CHECKS[name] = (sql, plan)
    on_graph(f"check_{name}", sql, plan)


NOT_TYPED = "NOT IN (SELECT node FROM ty)"


def _local(t: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    return inline(t.sparkSession, rows, names)


def _half_inverse(t: DataFrame) -> DataFrame:
    """The graph with the inverse of some placedBy edges."""
    back = t.where("p = 'placedBy' and s like '%1'").select(F.col("o").alias("s"), F.lit("placed").alias("p"), F.col("s").alias("o"), "o_kind")
    return gr.insert(t.select("s", "p", "o", "o_kind"), back)


check(
    "bidirectional", "SELECT NOT EXISTS (SELECT 1 FROM w x WHERE x.s = w.o AND x.p = i.q AND x.o = w.s) AS bad FROM w JOIN i USING (p)",
    lambda t, k: ck.bidirectional(_half_inverse(t), k["inverse"]),
    tables=f", w AS (SELECT s, p, o FROM e UNION SELECT o, 'placed', s FROM e WHERE p = 'placedBy' AND s LIKE '%1'), i AS (SELECT p, q FROM (VALUES {INV}) AS i(p, q) UNION SELECT q, p FROM (VALUES {INV}) AS i(p, q))",
)
CHECKS["process_flow"] = (
    " SELECT 'process_flow' AS \"check\", steps + links > 0 AS applicable, steps + links AS n_checked, (steps + links > 0 AND (steps < 2 OR links < 1))::BIGINT AS n_bad, steps + links = 0 OR (steps >= 2 AND links >= 1) AS passed FROM (SELECT (SELECT count(*) FROM ty WHERE c = 'Nation') AS steps, (SELECT count(*) FROM e WHERE p = 'inRegion') AS links)",
    lambda t, _: ck.process_flow(t, "inRegion", "Nation"),
)
on_graph("check_process_flow", *CHECKS["process_flow"])
on_graph(
    "flow_ends", " SELECT s AS node, 'start' AS place FROM e WHERE p IN ('inNation', 'inRegion') AND s NOT IN (SELECT o FROM e WHERE p IN ('inNation', 'inRegion')) GROUP BY s UNION ALL SELECT o, 'end' FROM e WHERE p IN ('inNation', 'inRegion') AND o NOT IN (SELECT s FROM e WHERE p IN ('inNation', 'inRegion')) GROUP BY o",
    lambda t, _: ck.flow_ends(t.where("p in ('inNation', 'inRegion')").withColumn("p", F.lit("then")), "then"),
)
check("orphan", "SELECT node NOT IN (SELECT s FROM e UNION SELECT o FROM e) AS bad FROM ty", lambda t, _: ck.orphan(t))
CLASSES = [("Customer",), ("Order",), ("Ghost",), ("Part",), ("Derived",)]
check("class_count", f"SELECT c NOT IN (SELECT c FROM ty) AS bad FROM (VALUES {_values(CLASSES)}) AS x(c) WHERE c <> 'Derived'", lambda t, _: ck.class_count(t, _local(t, CLASSES, "c string"), ["Derived"]))
check("fk_ref", f"SELECT o {NOT_TYPED} AS bad FROM e", lambda t, _: ck.fk_ref(t))
CHECKS["inference"] = (
    f"{ENTAILED} SELECT 'inference' AS \"check\", true AS applicable, (SELECT count(*) FROM f) AS n_checked, ((SELECT count(*) FROM f) <= (SELECT count(*) FROM g))::BIGINT AS n_bad, (SELECT count(*) FROM f) > (SELECT count(*) FROM g) AS passed",
    lambda t, k: ck.inference(t, _entailed(t, k, True)),
)
on_graph("check_inference", *CHECKS["inference"])
WRONG = [("placedBy", "Party"), ("inNation", "Supplier"), ("basedIn", "Agent")]
check(
    "domain", f"SELECT NOT EXISTS (SELECT 1 FROM closed x WHERE x.node = g.s AND x.c = w.c) AS bad FROM g JOIN (VALUES {_values(WRONG)}) AS w(p, c) USING (p) WHERE s IN (SELECT node FROM ty)",
    lambda t, k: ck.domain_axis(t, _local(t, WRONG, "p string, c string"), k["subclass"]), tables=CLOSED,
)
RANGES = [("placedBy", "Agent"), ("inNation", "Event")]
check(
    "range", f"SELECT NOT EXISTS (SELECT 1 FROM closed x WHERE x.node = e.o AND x.c = w.c) AS bad FROM e JOIN (VALUES {_values(RANGES)}) AS w(p, c) USING (p) WHERE o IN (SELECT node FROM ty)",
    lambda t, k: ck.range_axis(t, _local(t, RANGES, "p string, c string"), k["subclass"]), tables=CLOSED,
)
TERMS = [("Customer",), ("Ghost",), ("Nation",)]
check("schema_ref", f"SELECT term NOT IN (SELECT c FROM ty) AS bad FROM (VALUES {_values(TERMS)}) AS x(term)", lambda t, _: ck.schema_ref(_local(t, TERMS, "term string"), t.where("p = 'type'").select(F.col("o").alias("node"))))
check("existential_participation", "SELECT node NOT IN (SELECT s FROM g WHERE p = 'status') AS bad FROM ty WHERE c = 'Order'", lambda t, _: ck.existential(t, _local(t, [("Order", "status")], "c string, p string")))
check("property_coverage", "SELECT p NOT IN (SELECT p FROM g) AS bad FROM (VALUES ('status'), ('ghost')) AS x(p)", lambda t, _: ck.property_coverage(t, _local(t, [("status",), ("ghost",)], "p string"), 0.5), allowed=0.5)
# both balances end so; supplierBalance has a rule of its own, which is longer
LIMITS = [("balance", 0.0, 9000.0), ("supplierBalance", -5000.0, 99999.0)]
check("value_ranges", "SELECT CASE WHEN p = 'balance' THEN o_num < 0 OR o_num > 9000 ELSE o_num < -5000 OR o_num > 99999 END AS bad FROM g WHERE p IN ('balance', 'supplierBalance')", lambda t, _: ck.value_ranges(t, _local(t, LIMITS, "p string, low double, high double")))
FED = [("Customer",), ("Ghost",), ("Orders",), ("PartMaster",), ("Agent",), ("Made",)]
check(
    "tbox_fitness", "SELECT c IN ('Ghost') AS bad FROM (VALUES ('Customer'), ('Ghost'), ('Orders'), ('PartMaster'), ('Made')) AS x(c)",
    lambda t, k: ck.tbox_fitness(_local(t, FED, "c string"), _local(t, [("customer",), ("ORDERS",), ("part",)], "name string"), _local(t, [("Made",)], "c string"), k["subclass"]), allowed=0.5,
)
FKS = [("Order", "Customer"), ("Customer", "Nation"), ("Order", "Part"), ("Part", "Part")]
check(
    "fk_op", f"SELECT (d, r) NOT IN (VALUES {_values([(d, r) for _, d, r in sg.OBJECT_PROPERTIES])}) AS bad FROM (VALUES {_values(FKS)}) AS x(d, r) WHERE d <> r",
    lambda t, _: ck.fk_op(_local(t, FKS, "domain string, range string"), _local(t, [(d, r) for _, d, r in sg.OBJECT_PROPERTIES], "domain string, range string")), allowed=0.15,
)
DUE = [("Order", "status", 0.999), ("Order", "total", 0.9), ("Ghost", "total", 0.5), ("Derived", "total", 0.5), ("Order", "priority", 0.99)]
check(
    "prop_completeness", f"SELECT coalesce((SELECT count(DISTINCT s) FROM g WHERE p = x.p AND s IN (SELECT node FROM ty WHERE c = x.c)) / nullif((SELECT count(*) FROM ty WHERE c = x.c), 0)::DOUBLE, 0) < CASE WHEN x.p = 'status' THEN least(x.least, 0.9) ELSE x.least END AS bad FROM (VALUES {_values(DUE)}) AS x(c, p, least) WHERE c <> 'Derived'",
    lambda t, _: ck.prop_completeness(t, _local(t, DUE, "c string, p string, least double"), _local(t, [("Order", "status", 0.9)], "c string, p string, rate double"), ["Derived"]),
)
OUT = ", q AS (SELECT p, quantile_cont(o_num, 0.25) AS q1, quantile_cont(o_num, 0.75) AS q3, avg(o_num) AS m, stddev_samp(o_num) AS sd FROM g WHERE o_num IS NOT NULL GROUP BY p HAVING count(*) >= 3)"
check(
    "numeric_outliers", "SELECT CASE WHEN q3 > q1 THEN o_num < q1 - 1.5 * (q3 - q1) OR o_num > q3 + 1.5 * (q3 - q1) ELSE abs(o_num - m) > 3 * sd END AS bad FROM g JOIN q USING (p) WHERE o_num IS NOT NULL",
    lambda t, _: ck.numeric_outliers(t), allowed=0.05, tables=OUT,
)
check("dangling", f"SELECT DISTINCT o, o {NOT_TYPED} AS bad FROM e", lambda t, _: ck.dangling(t, 0.2), allowed=0.2)
check("undeclared_op", "SELECT DISTINCT p, p NOT IN ('inNation', 'placedBy') AS bad FROM e WHERE p <> 'basedIn'", lambda t, _: ck.undeclared_op(t, _local(t, [("inNation",), ("placedBy",)], "p string"), _local(t, [("basedIn",)], "p string")))
check("undeclared_dp", "SELECT DISTINCT p, p NOT IN ('status', 'total') AS bad FROM g WHERE o_kind = 'lit'", lambda t, _: ck.undeclared_dp(t, _local(t, [("status",), ("total",)], "p string")))
STALE = "CASE WHEN p = 'status' AND o = 'X' THEN 'N/A' WHEN p = 'priority' AND s LIKE '%13' THEN '' WHEN p = 'segment' AND o = 'BUILDING' THEN '-' WHEN p = 'brand' AND s LIKE '%7' THEN '-' ELSE o END"
check(
    "string_patterns", f"SELECT lower(v) IN ('n/a', 'na', 'null', 'undefined', 'none', 'nan', '-', '') AND NOT (v = '-' AND p = 'segment') AS bad FROM (SELECT p, {STALE} AS v FROM g WHERE o_kind = 'lit' AND o_num IS NULL)",
    lambda t, _: ck.string_patterns(t.withColumn("o", F.expr(STALE)), ["segment"]),
)
on_graph(
    "concentrated_values", " SELECT p, o AS value, n / total::DOUBLE AS share, total AS n FROM (SELECT p, o, count(*) AS n, (sum(count(*)) OVER (PARTITION BY p))::BIGINT AS total FROM g WHERE o_kind = 'lit' AND o_num IS NULL GROUP BY p, o QUALIFY row_number() OVER (PARTITION BY p ORDER BY count(*) DESC, o) = 1) WHERE total >= 5 AND n > total * 0.3",
    lambda t, _: ck.concentrated_values(t, 0.3),
)
check("functional", "SELECT count(DISTINCT o) > 1 AS bad FROM g WHERE p = 'status' GROUP BY s", lambda t, _: ck.functional(t, ["status"]))
FAR = (
    ", r AS (SELECT o AS s, p, s AS o FROM e), d AS (SELECT p, s, count(*)::DOUBLE AS n FROM r GROUP BY p, s), q AS (SELECT p, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3, list_sort(list(n))[count(*) // 2 + 1] AS md FROM d GROUP BY p), "
    "m AS (SELECT p, median(abs(n - md)) AS mad FROM d JOIN q USING (p) GROUP BY p)"
)
check(
    "relationship_outliers", "SELECT n > CASE WHEN q3 > q1 THEN q3 + 1.5 * (q3 - q1) ELSE md + 3 * 1.4826 * mad END AS bad FROM d JOIN q USING (p) JOIN m USING (p)",
    lambda t, _: ck.relationship_outliers(t.where("o_kind = 'iri' and p <> 'type'").select(F.col("o").alias("s"), "p", F.col("s").alias("o"), "o_kind")), allowed=0.05, tables=FAR,
)
check(
    "cardinality", "SELECT n < low OR n > high AS bad FROM (SELECT low, high, (SELECT count(DISTINCT o) FROM g WHERE g.s = c.node AND g.p = x.p) AS n FROM closed c JOIN (VALUES ('Event', 'status', 1, 1), ('Party', 'inNation', 1, 1)) AS x(c, p, low, high) USING (c))",
    lambda t, k: ck.cardinality(t, _local(t, [("Event", "status", 1, 1), ("Party", "inNation", 1, 1)], "c string, p string, low int, high int"), k["subclass"]), tables=CLOSED,
)
check(
    "disjoint", "SELECT count(DISTINCT c) > 1 AS bad FROM (SELECT node, c FROM ty UNION SELECT node, 'Region' FROM ty WHERE node LIKE 'Nation%4') GROUP BY node",
    lambda t, _: ck.disjoint(t.select("s", "p", "o").unionByName(t.where("p = 'type' and s like 'Nation%4'").select("s", "p", F.lit("Region").alias("o"))), [["Nation", "Region"], ["Customer", "Order"]]),
)
check("master_orphan", "SELECT node NOT IN (SELECT o FROM e) AS bad FROM ty WHERE c IN ('Customer')", lambda t, _: ck.master_orphan(t, ["Customer", "Part"], 0.5, ["Part"]), "cw_master_orphan", 0.5)
check("fk_unresolved", f"SELECT o {NOT_TYPED} AND o <> 'Customer_-97' AS bad FROM e", lambda t, _: ck.fk_unresolved(t, _local(t, [("Customer_-97",)], "node string")), "cw_fk_unresolved", 0.05)


def _as_table(sql: str) -> str:
    """A check's SQL as a table of its own: expressions before it become its own WITH."""
    return f"({('WITH RECURSIVE' + sql[1:]) if sql.startswith(',') else sql})"


ALL_CHECKS = " UNION ALL ".join(f"SELECT * FROM {_as_table(sql)}" for sql, _ in CHECKS.values())


def _report(t: DataFrame, k: dict[str, DataFrame]) -> DataFrame:
    return ck.report(*[plan(t, k) for _, plan in CHECKS.values()])


on_graph("check_report", f" {ALL_CHECKS}", _report)
on_graph(
    "check_report_score",
    f" SELECT count(*) FILTER (passed OR NOT applicable) AS passed, count(*) AS total, round(count(*) FILTER (passed OR NOT applicable) * 100.0::DOUBLE / count(*), 6) AS score, round(count(*) FILTER (passed AND applicable) * 100.0::DOUBLE / greatest(count(*) FILTER (applicable), 1), 6) AS measured_score, count(*) FILTER (NOT applicable AND (n_bad > 0 OR NOT passed)) > 0 AS unreliable FROM ({ALL_CHECKS})",
    lambda t, k: ck.scored(_report(t, k)),
)

# --- dictionary, drift, topology, property graph, history ---------------------------------------------------------------------------

on_graph("dict_numeric_stats", " SELECT p, count(*) AS n, min(o_num) AS low, max(o_num) AS high, round(avg(o_num), 6) AS mean, round(quantile_cont(o_num, 0.1), 6) AS p10, round(quantile_cont(o_num, 0.5), 6) AS p50, round(quantile_cont(o_num, 0.9), 6) AS p90 FROM g WHERE o_num IS NOT NULL GROUP BY p", lambda t, _: an.numeric_stats(t))
on_graph(
    "dict_distinct", ", d AS (SELECT DISTINCT p, o FROM g WHERE o_kind = 'lit' AND o_num IS NULL), n AS (SELECT p, count(*) AS n_distinct FROM d GROUP BY p), r AS (SELECT p, o, row_number() OVER (PARTITION BY p ORDER BY o) AS r FROM d) SELECT p, n_distinct, string_agg(o, '|' ORDER BY o) AS listed FROM r JOIN n USING (p) WHERE r <= CASE WHEN n_distinct <= 20 THEN 20 ELSE 5 END GROUP BY p, n_distinct",
    lambda t, _: an.distinct_values(t),
)
on_graph("unit_mismatch", " SELECT p, min(o_num) AS low, max(o_num) AS high FROM g WHERE o_num > 0 AND p <> 'size' GROUP BY p HAVING count(*) >= 5 AND max(o_num) >= 50 * min(o_num)", lambda t, _: an.unit_mismatch(t, ["size"]))
LINKS = ", l AS (SELECT a.c AS d, e.p, b.c AS r, count(*) AS n FROM e JOIN ty a ON a.node = e.s JOIN ty b ON b.node = e.o GROUP BY 1, 2, 3)"
on_graph("class_links", f"{LINKS} SELECT d AS domain, p, r AS range, n FROM l", lambda t, _: an.class_links(t))
on_graph(
    "two_hop_paths", f"{LINKS} SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target, via)::INT AS rank FROM (SELECT x.d AS source, x.r AS via, y.r AS target, sum(least(x.n, y.n))::BIGINT AS score FROM l x JOIN l y ON x.r = y.d WHERE x.d <> y.r GROUP BY 1, 2, 3)",
    lambda t, _: an.two_hop_paths(an.class_links(t)),
)
on_graph("column_index", " SELECT p, string_agg(DISTINCT c, '|' ORDER BY c) AS classes FROM g JOIN ty ON g.s = ty.node GROUP BY p", lambda t, _: t.join(t.where("p = 'type'").select("s", F.col("o").alias("c")), "s").groupBy("p").agg(F.array_join(F.sort_array(F.collect_set("c")), "|").alias("classes")))


@query("WITH a AS (SELECT DISTINCT CASE WHEN p_size >= 40 THEN 'OLD ' || p_type ELSE p_type END AS v FROM part), b AS (SELECT DISTINCT CASE WHEN p_partkey % 50 = 1 THEN 'Quartz ' || p_brand ELSE p_type END AS v FROM part) SELECT 'added' AS change, v AS value FROM b WHERE v NOT IN (SELECT v FROM a) UNION ALL SELECT 'removed', v FROM a WHERE v NOT IN (SELECT v FROM b)")
def drift_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.drift(*_snapshots(spark, sf_dir))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All parts' types before and after changes: large parts' types were named otherwise, some became brands."""
    part = table(spark, sf_dir, "part")
    old = part.select(F.expr("CASE WHEN p_size >= 40 THEN 'OLD ' || p_type ELSE p_type END").alias("value"))
    return old, part.select(F.expr("CASE WHEN p_partkey % 50 = 1 THEN 'Quartz ' || p_brand ELSE p_type END").alias("value"))


GRAMS = "CASE WHEN length({v}) < 3 THEN [{v}] ELSE list_distinct(list_transform(range(1, length({v}) - 1), lambda i: substr({v}, i, 3))) END"


@query(f"""WITH a AS (SELECT DISTINCT CASE WHEN p_size >= 40 THEN 'OLD ' || p_type ELSE p_type END AS v FROM part), b AS (SELECT DISTINCT CASE WHEN p_partkey % 50 = 1 THEN 'Quartz ' || p_brand ELSE p_type END AS v FROM part),
n AS (SELECT v, {GRAMS.format(v="v")} AS g FROM b WHERE v NOT IN (SELECT v FROM a) ORDER BY v LIMIT 20), o AS (SELECT {GRAMS.format(v="v")} AS g FROM a)
SELECT v AS value, max(len(list_intersect(n.g, o.g)) / len(list_distinct(list_concat(n.g, o.g)))::DOUBLE) AS similarity FROM n, o GROUP BY v HAVING max(len(list_intersect(n.g, o.g)) / len(list_distinct(list_concat(n.g, o.g)))::DOUBLE) < 0.3""")
def drift_emerging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.emerging(*_snapshots(spark, sf_dir))


@query("SELECT count(*) FILTER (c_custkey % 10 <> 0) * 100.0 / count(*) AS row_recall, count(*) FILTER (c_custkey % 10 <> 0 AND c_custkey % 7 <> 0) * 100.0 / count(*) AS cell_recall, count(*) FILTER (c_custkey % 10 = 5) AS n_extra FROM customer")
def roundtrip_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers rebuilt from the graph: every tenth is missing, every seventh has another segment as its last value, and some come under a strange name."""
    source = table(spark, sf_dir, "customer").select(F.concat(F.lit("Customer_"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_mktsegment").alias("segment"))
    t = sg.graph(spark, sf_dir).where("s like 'Customer%'").withColumn("k", F.substring_index("s", "_", -1).cast("long")).withColumn("at", F.lit(1))
    strange = t.where("k % 10 = 5").withColumn("s", F.concat(F.lit("Strange"), "s"))
    later = t.where("p = 'segment' and k % 7 = 0").withColumns({"o": F.lit("?"), "at": F.lit(2)})
    return an.roundtrip(source, an.pivoted(t.where("k % 10 <> 0").union(strange).union(later), "Customer", ["segment"], "at"), "node", ["segment"])


# all pairs that are reachable are too many for SQL: the tests hold this query against union-find
QUERIES["components"] = lambda spark, sf_dir: gr.components(sg.graph(spark, sf_dir).where("o_kind = 'iri' and p <> 'type'").select(F.col("s").alias("a"), F.col("o").alias("b")))
DEG = ", d AS (SELECT node, count(*) AS degree FROM (SELECT s AS node FROM (SELECT DISTINCT s, o FROM e) UNION ALL SELECT o FROM (SELECT DISTINCT s, o FROM e)) GROUP BY node)"
on_graph(
    "degree_stats", f"{DEG}, r AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM d) SELECT max(n) AS n, avg(degree) AS mean, max(degree) FILTER (i = n * 50 // 100) AS p50, max(degree) FILTER (i = n * 90 // 100) AS p90, max(degree) FILTER (i = n * 99 // 100) AS p99, max(degree) AS highest FROM r",
    lambda t, _: an.degree_stats(an.degrees(t)),
)
on_graph("top_degree", f"{DEG} SELECT node, degree FROM d ORDER BY degree DESC, node LIMIT 20", lambda t, _: an.degrees(t).orderBy(F.desc("degree"), "node").limit(20))
on_graph(
    "graph_diff", " SELECT 'left' AS side, s, p, o FROM g WHERE p = 'status' AND o = 'P' UNION ALL SELECT 'right', s, p, 'Z' FROM g WHERE p = 'status' AND o = 'X'",
    lambda t, _: an.graph_diff(t, gr.insert(t.where("not (p = 'status' and o = 'P')").select("s", "p", "o"), t.where("p = 'status' and o = 'X'").select("s", "p", F.lit("Z").alias("o")))),
)
on_graph(
    "graph_hash",
    """, line AS (SELECT DISTINCT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'lit' THEN '"' || replace(replace(o, '\\', '\\\\'), '"', '\\"') || '"' ELSE '<' || o || '>' END || ' .' AS line FROM g),
    h AS (SELECT sha256(line) AS h FROM line),
    c AS (SELECT substr(h, 1, 6) || sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM h GROUP BY substr(h, 1, 6)),
    d AS (SELECT substr(h, 1, 3) || sha256(string_agg(h, '' ORDER BY h)) AS h, sum(n) AS n FROM c GROUP BY substr(h, 1, 3))
    SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM d""",
    lambda t, _: an.graph_hash(t),
)


@query("SELECT 'Customer_' || c_custkey AS instance, 'customer' AS source_table, c_custkey::VARCHAR AS source_key FROM customer")
def row_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.row_provenance(table(spark, sf_dir, "customer"), "customer", "c_custkey", "Customer_")


on_graph(
    "confidence_summary", f" SELECT source, count(*) AS n, CASE source WHEN 'csv' THEN 1.0 WHEN 'fk_verified' THEN 0.95 ELSE 0.3 END::DOUBLE AS confidence FROM (SELECT CASE WHEN o_kind = 'lit' OR p = 'type' THEN 'csv' WHEN o {NOT_TYPED} THEN 'fk_guess' ELSE 'fk_verified' END AS source FROM g) GROUP BY source",
    lambda t, _: an.confidence_summary(
        t.join(t.where("p = 'type'").select(F.col("s").alias("o"), F.lit(True).alias("typed")), "o", "left"),
        F.when((F.col("o_kind") == "lit") | (F.col("p") == "type"), "csv").when(F.col("typed").isNull(), "fk_guess").otherwise("fk_verified"),
    ),
)
on_graph("statement_ids", " SELECT 'stmt_' || substr(sha256(s || '|' || p || '|' || o), 1, 16) AS id, s, p, o FROM g", lambda t, _: t.select(an.statement_id("s", "p", "o").alias("id"), "s", "p", "o"))
on_graph("rank_filter", " SELECT s, o FROM e WHERE p = 'placedBy' AND s NOT LIKE '%9'", lambda t, _: t.where("p = 'placedBy'").withColumn("rank", F.when(F.col("s").endswith("9"), "deprecated")).where(F.coalesce("rank", F.lit("normal")).isin("normal", "preferred")).select("s", "o"))
on_graph(
    "lpg_nodes", " SELECT node AS uri, c AS labels, (SELECT string_agg(k, ';' ORDER BY k) FROM (SELECT p || '=' || string_agg(o, '|' ORDER BY o) AS k FROM g WHERE g.s = ty.node AND o_kind = 'lit' GROUP BY p)) AS props FROM ty",
    lambda t, _: an.lpg_nodes(t).select("uri", F.array_join("labels", "|").alias("labels"), F.array_join(F.transform(F.sort_array(F.map_keys("props")), lambda x: F.concat(x, F.lit("="), F.array_join(F.element_at("props", x), "|"))), ";").alias("props")),
)
on_graph(
    "lpg_inverse_dedup", " SELECT s AS start, o AS \"end\", p AS type FROM e",
    lambda t, k: an.lpg_rels(rs.inverse_complete(t, k["inverse"]), k["inverse"], ["inNation", "placedBy"]),
)
on_graph(
    "lpg_rels",
    """ SELECT CASE WHEN p = 'placedBy' THEN o ELSE s END AS start, CASE WHEN p = 'placedBy' THEN s ELSE o END AS "end", CASE WHEN p = 'placedBy' THEN 'placed' ELSE p END AS type FROM e WHERE s <> o""",
    lambda t, k: an.lpg_rels(t, k["inverse"].union(k["inverse"].select("q", "p"))),
)  # pairs are declared both ways, and the lesser name stays
on_graph("lpg_sparse", " SELECT ty.c, g.p, count(DISTINCT g.s) / (SELECT count(*) FROM ty y WHERE y.c = ty.c)::DOUBLE AS share FROM g JOIN ty ON g.s = ty.node WHERE o_kind = 'lit' GROUP BY ty.c, g.p HAVING count(DISTINCT g.s) / (SELECT count(*) FROM ty y WHERE y.c = ty.c)::DOUBLE < 0.995", lambda t, _: an.sparse_properties(t, 0.995))
KINDS_SQL = "CASE WHEN p LIKE 's%' AND o IN ('X', '1.00') THEN 'other' WHEN o_num IS NULL THEN 'string' ELSE 'decimal' END"
SOURCES = [("Customer", "customer"), ("Order", "orders"), ("Part", "part"), ("Nation", "nation")]
DTS = [(p, "decimal" if p in ("balance", "supplierBalance", "size", "price", "total") else "string") for p, _ in sg.DATA_PROPERTIES]


def _instance_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(sg.graph(spark, sf_dir), "graph", "p").withColumn("o_dt", F.when(F.col("o_kind") == "lit", F.expr(KINDS_SQL)))
    rows = [table(spark, sf_dir, name).agg((F.count("*") * (2 if c == "Nation" else 1)).alias("rows")).select(F.lit(c).alias("c"), "rows") for c, name in SOURCES]
    sources = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return an.instance_quality(t, sg.schema_rows(spark)["domain"], [p for p, _, _ in sg.OBJECT_PROPERTIES], sources, inline(spark, DTS, "p string, dt string"))


QUERIES["instance_quality"] = _instance_quality
ORACLES["instance_quality"] = f"""{G}, d AS (SELECT DISTINCT p, c FROM {DOM}), own AS (SELECT node AS s, c FROM ty WHERE c IN (SELECT c FROM d)),
k AS (SELECT c, count(*) AS declared FROM d GROUP BY c), n AS (SELECT c, count(*) AS instances FROM own GROUP BY c),
a AS (SELECT c, count(*) AS actual, count(*) FILTER ((p, c) IN (SELECT p, c FROM d)) AS filled FROM (SELECT DISTINCT s, p FROM g WHERE p <> 'type') JOIN own USING (s) GROUP BY c),
r AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, count(*) * {2 if c == 'Nation' else 1} AS r FROM {t}" for c, t in SOURCES)}),
m AS (SELECT 'population' AS metric, round(avg(coalesce(instances, 0) / r::DOUBLE * 100), 1) AS value FROM r LEFT JOIN n USING (c)
UNION ALL SELECT 'completeness', round(avg(coalesce(filled, 0) / (instances * declared)::DOUBLE * 100), 1) FROM n JOIN k USING (c) LEFT JOIN a USING (c)
UNION ALL SELECT 'richness', round(least(avg(coalesce(actual, 0) / (instances * declared)::DOUBLE * 100), 100.0::DOUBLE), 1) FROM n JOIN k USING (c) LEFT JOIN a USING (c)
UNION ALL SELECT 'interlinking', round(count(*) FILTER (s IN (SELECT s FROM e)) * 100.0::DOUBLE / count(*), 1) FROM own
UNION ALL SELECT 'datatypes', round(count(*) FILTER ({KINDS_SQL} = dt) * 100.0::DOUBLE / count(*), 1) FROM g JOIN (VALUES {_values(DTS)}) AS v(p, dt) USING (p) WHERE o_kind = 'lit')
SELECT * FROM m UNION ALL SELECT 'overall', round(avg(value), 1) FROM m"""


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 480 HOURS GROUP BY user_id HAVING count(*) >= 2")
def failure_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.failure_patterns(table(spark, sf_dir, "events"), "error", "2024-01-31 00:00:00", 480, 2)


RUNS = "(SELECT user_id AS case_id, event_id AS run, CASE WHEN event_type IN ('error', 'click') THEN 'fail' ELSE 'pass' END AS status FROM events)"


@query(f"SELECT case_id, run FROM (SELECT *, lag(status) OVER (PARTITION BY case_id ORDER BY run) AS b FROM {RUNS}) WHERE b = 'pass' AND status = 'fail'")
def golden_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").selectExpr("user_id as case_id", "event_id as run", "CASE WHEN event_type IN ('error', 'click') THEN 'fail' ELSE 'pass' END AS status")
    return an.regressions(runs, "case_id", "run", "status")


@query("""WITH f AS (SELECT DISTINCT user_id AS run, event_type AS c FROM events), n AS (SELECT c AS a, count(*) AS n FROM f GROUP BY c HAVING count(*) >= 5)
SELECT x.c AS a, y.c AS b, count(*) AS both, count(*) / n.n::DOUBLE AS share FROM f x JOIN f y ON x.run = y.run AND x.c <> y.c JOIN n ON n.a = x.c GROUP BY x.c, y.c, n.n HAVING count(*) / n.n::DOUBLE >= 0.9""")
def check_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user is a run, and every event type a check that failed in it."""
    return an.cooccurrence(table(spark, sf_dir, "events").selectExpr("user_id as run", "event_type as check"))


MUTANTS = {"drop_type": "not (p = 'type' and s like 'Nation%')", "drop_status": "p <> 'status'", "drop_edges": "p <> 'placedBy'"}
SENSITIVE = " UNION ALL ".join(f"SELECT '{m}' AS mutant, 'fk_ref' AS \"check\", (SELECT count(*) FROM e x WHERE {w.replace('not (', 'NOT (')} AND o NOT IN (SELECT s FROM g WHERE p = 'type' AND {w})) <> (SELECT count(*) FROM e WHERE o {NOT_TYPED}) AS killed UNION ALL SELECT '{m}', 'functional', (SELECT count(*) FROM (SELECT s FROM g WHERE p = 'status' AND {w} GROUP BY s HAVING count(DISTINCT o) > 1)) <> (SELECT count(*) FROM (SELECT s FROM g WHERE p = 'status' GROUP BY s HAVING count(DISTINCT o) > 1))" for m, w in MUTANTS.items())


def _sensitivity(t: DataFrame, _: dict[str, DataFrame]) -> DataFrame:
    base = ck.report(ck.fk_ref(t), ck.functional(t, ["status"])).select("check", F.col("n_bad").alias("base"))
    out = None
    for name, keep in MUTANTS.items():
        mutated = t.where(keep)
        one = ck.report(ck.fk_ref(mutated), ck.functional(mutated, ["status"])).join(base, "check").select(F.lit(name).alias("mutant"), "check", (F.col("n_bad") != F.col("base")).alias("killed"))
        out = one if out is None else out.unionByName(one)
    return out


on_graph("mutation_sensitivity", f" {SENSITIVE}", _sensitivity)

# --- quality dimensions, distances, cell provenance ---------------------------------------------------------------------------------

SOURCES_OF = "CASE WHEN o_kind = 'lit' OR p = 'type' THEN 'csv' ELSE 'fk_verified' END"
FULL = "SELECT 'http://a.example/' || split_part(s, '_', 1) || '#' || s AS s, 'http://a.example/schema#' || p AS p, o, o_kind, CASE WHEN p LIKE 's%' AND o IN ('X', '1.00') THEN 'other' WHEN o_num IS NULL THEN 'string' ELSE 'decimal' END AS dt FROM g"


def _full_iris(t: DataFrame) -> DataFrame:
    """The graph with full IRIs and data types, of which some statuses and sizes differ from their property's others."""
    kind = F.when(F.col("p").startswith("s") & F.col("o").isin("X", "1.00"), "other").when(F.col("o_num").isNull(), "string").otherwise("decimal")
    return t.select(F.concat(F.lit("http://a.example/"), F.substring_index("s", "_", 1), F.lit("#"), "s").alias("s"), F.concat(F.lit("http://a.example/schema#"), "p").alias("p"), "o", "o_kind", F.when(F.col("o_kind") == "lit", kind).alias("o_dt"))


def _dimensions(t: DataFrame, _: dict[str, DataFrame]) -> DataFrame:
    statements = t.select(F.when((F.col("o_kind") == "lit") | (F.col("p") == "type"), "csv").otherwise("fk_verified").alias("source"))
    statements = statements.select("source", F.when(F.col("source") == "csv", 1.0).otherwise(0.95).alias("confidence"))
    return dm.dimensions(dm.amount(t), dm.trust(statements), dm.verifiability(t.where("p = 'inRegion'")), dm.representation(_full_iris(t)))


on_graph(
    "quality_dimensions",
    f""", f AS ({FULL}), n AS (SELECT count(DISTINCT regexp_extract(i, '^(.*#)', 1)) AS n FROM (SELECT s AS i FROM f UNION ALL SELECT p FROM f)),
    k AS (SELECT count(*) AS props, count(*) FILTER (kinds > 1) AS mixed FROM (SELECT p, count(DISTINCT dt) AS kinds FROM f WHERE o_kind = 'lit' GROUP BY p)),
    d AS (SELECT 'amount' AS dimension, floor(least(100.0, 10 + 10 * log10(count(*))))::DOUBLE AS score FROM g
    UNION ALL SELECT 'trust', round(round(avg(CASE {SOURCES_OF} WHEN 'csv' THEN 1.0 ELSE 0.95 END::DOUBLE), 3) * 100 * least(1.0, 0.5 + count(DISTINCT {SOURCES_OF}) * 0.15))::DOUBLE FROM g
    UNION ALL SELECT 'verifiability', floor(least(100.0, 20 + 30 * log10(count(*) + 1)))::DOUBLE FROM e WHERE p = 'inRegion'
    UNION ALL SELECT 'representation', round((CASE WHEN n < 3 THEN 50.0 WHEN n <= 15 THEN 100.0 ELSE greatest(0.0, 100.0 - (n - 15) * 5) END::DOUBLE + round((1 - mixed / props::DOUBLE) * 100, 1)) / 2, 1)::DOUBLE FROM n, k)
    SELECT * FROM d UNION ALL SELECT 'overall', round(avg(score), 1) FROM d""",
    _dimensions,
)
on_graph(
    "approx_diameter",
    """, k AS (SELECT s AS a, o AS b FROM e), x AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
    src AS (SELECT a AS source FROM (SELECT DISTINCT a FROM x) ORDER BY md5(a), a LIMIT 50),
    walk AS (SELECT source, source AS node, 0 AS d FROM src UNION SELECT w.source, x.b, w.d + 1 FROM walk w JOIN x ON x.a = w.node WHERE w.d < 8),
    ecc AS (SELECT source, max(d) AS d FROM (SELECT source, node, min(d) AS d FROM walk GROUP BY ALL) GROUP BY source)
    SELECT count(*) AS sampled_sources, max(d) AS approx_diameter, list_sort(list(d))[count(*) // 2 + 1] AS median_eccentricity FROM ecc""",
    lambda t, _: dm.approximate_diameter(t.where("o_kind = 'iri' and p <> 'type'").select(F.col("s").alias("a"), F.col("o").alias("b"))),
)


@query("""WITH a AS (SELECT CASE WHEN event_type = 'error' THEN 'fault' ELSE event_type END AS metric, count(*) AS v FROM events GROUP BY 1), b AS (SELECT CASE WHEN event_id % 5 = 0 THEN 'other' ELSE event_type END AS metric, count(*) AS v FROM events GROUP BY 1)
SELECT metric, a.v AS before, b.v AS after, b.v - a.v AS delta, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN b.v > a.v THEN 'up' WHEN b.v < a.v THEN 'down' ELSE 'same' END AS status FROM a FULL JOIN b USING (metric)""")
def metrics_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all events by type, before and after types were renamed."""
    of = lambda metric: table(spark, sf_dir, "events").groupBy(F.expr(metric).alias("metric")).agg(F.count("*").alias("value"))
    return dm.metrics_diff(of("CASE WHEN event_type = 'error' THEN 'fault' ELSE event_type END"), of("CASE WHEN event_id % 5 = 0 THEN 'other' ELSE event_type END"))


CELLS = {"segment": "c_mktsegment", "balance": "c_acctbal"}


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dm.cell_provenance(table(spark, sf_dir, "customer"), "customer", F.concat(F.lit("Customer_"), F.col("c_custkey").cast("string")), "c_custkey", CELLS)


@query(
    "WITH r AS (SELECT c_custkey::VARCHAR AS n, 'prov://customer#row=' || c_custkey AS r FROM customer), c AS (SELECT n, r, r || '&col=' || col AS c, prop, col FROM r, (VALUES " + _values(list(CELLS.items())) + ") AS v(prop, col)), "
    "w AS (SELECT n, r AS x FROM r UNION ALL SELECT n, c FROM c) SELECT 'Customer_' || n AS s, 'wasDerivedFrom' AS p, r AS o FROM r UNION ALL SELECT x, 'type', 'Entity' FROM w UNION ALL SELECT x, 'csvTable', 'customer' FROM w UNION ALL SELECT x, 'rowNumber', n FROM w "
    "UNION ALL SELECT c, 'column', col FROM c UNION ALL SELECT c, 'property', prop FROM c UNION ALL SELECT c, 'wasDerivedFrom', r FROM c"
)
def cell_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query("SELECT 'Customer_' || c_custkey AS instance, 'customer' AS source_table, c_custkey AS row_number, prop AS property, col AS \"column\" FROM customer, (VALUES " + _values(list(CELLS.items())) + ") AS v(prop, col)")
def trace_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dm.traced_cells(_cells(spark, sf_dir))


LABELLED = [(c, lang) for c, _ in sg.SUBCLASSES for lang in ("en", "ko") if (c, lang) != ("Order", "ko")]


@query(f"""WITH t AS (SELECT a AS term FROM (VALUES {_values(sg.SUBCLASSES)}) AS s(a, b) UNION SELECT b FROM (VALUES {_values(sg.SUBCLASSES)}) AS s(a, b)), l AS (SELECT * FROM (VALUES {_values(LABELLED)}) AS l(term, lang)),
x AS (SELECT term IN (SELECT term FROM l) AS a, term LIKE '%r' AS b, term IN (SELECT term FROM l WHERE lang = 'en') AND term IN (SELECT term FROM l WHERE lang = 'ko') AS c FROM t),
y AS (SELECT count(*) FILTER (a) * 100.0::DOUBLE / count(*) AS a, count(*) FILTER (b) * 100.0::DOUBLE / count(*) AS b, count(*) FILTER (c) * 100.0::DOUBLE / count(*) AS c FROM x)
SELECT round(a, 6) AS label_pct, round(b, 6) AS comment_pct, round(c, 6) AS bilingual_pct, round(a * 0.4 + b * 0.3 + c * 0.3, 6) AS score FROM y""")
def understandability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and comments of the mapping's classes; it doesn't depend on the tables."""
    terms = inline(spark, [(c,) for pair in sg.SUBCLASSES for c in pair], "term string")
    return dm.understandability(terms, inline(spark, LABELLED, "term string, lang string"), terms.where("term like '%r'"))
