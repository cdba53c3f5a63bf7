"""Queries of readers, keys, ranges, class connectivity and causal chains, with their oracles; they add to the first catalogue's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalogue import _values, query
from graphloom.catalogue_rules import on_kept_graph
from graphloom.operators import analytics as an
from graphloom.operators import blank as bl
from graphloom.operators import evaluation as ev
from graphloom.operators import ingest as ig
from graphloom.operators import ranges as rg
from graphloom.plans import star_graph as sg
from graphloom.sources import tables as st
from graphloom.sources.tables import inline, table
from graphloom.storage import shared_folder, stored
from graphloom.streaming.incremental import resolved_references, run_to_table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- readers and writers by what they write -----------------------------------------------------------------------------------------


@query("""SELECT p_partkey::VARCHAR AS id, p_name || CASE p_partkey % 4 WHEN 0 THEN ', "' || p_brand || '"' WHEN 1 THEN chr(10) || 'second line' WHEN 2 THEN ' \\ end' ELSE '' END AS name,
CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS kind FROM part""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as CSV by the usual quoting, with commas, quotes, line ends and backslashes in cells, and read again."""
    tail = "CASE p_partkey % 4 WHEN 0 THEN concat(', \"', p_brand, '\"') WHEN 1 THEN concat(char(10), 'second line') WHEN 2 THEN concat(' ', char(92), ' end') ELSE '' END"
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as id", f"concat(p_name, {tail}) as name", "CASE WHEN p_partkey % 5 <> 0 THEN p_type END as kind")
    path = _folder(spark, "csv")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return st.read_csv(spark, path)


@on_kept_graph(" SELECT s, p, o, o_kind FROM g")
def ntriples_round_trip(t: DataFrame, _: dict[str, DataFrame]) -> DataFrame:
    """The graph as lines of N-Triples, a third of them without spaces and a third with a comment, and read again."""
    spark, path = t.sparkSession, _folder(t.sparkSession, "ntriples")
    n = F.pmod(F.xxhash64("value"), F.lit(3))
    line = F.when(n == 0, F.regexp_replace("value", r"> (?=[<\"])", ">")).when(n == 1, F.concat("value", F.lit(" # as stated"))).otherwise(F.col("value"))
    st.ntriples_lines(t).select(line.alias("value")).write.text(path)
    return st.read_ntriples(spark, path).select("s", "p", "o", "o_kind")


@on_kept_graph(""", n AS (SELECT count(DISTINCT node) AS n FROM ty) SELECT 'nodes' AS what, n FROM n UNION ALL SELECT p, count(*) FROM e WHERE p <> 'placedBy' GROUP BY p UNION ALL SELECT 'placed', count(*) FROM e WHERE p = 'placedBy'""")
def property_graph_files(t: DataFrame, k: dict[str, DataFrame]) -> DataFrame:
    """The property graph as CSV files, and the counts of what they hold."""
    spark, path = t.sparkSession, _folder(t.sparkSession, "property-graph")
    st.write_property_graph(an.lpg_nodes(t), an.lpg_rels(t, k["inverse"]), path)
    nodes = st.read_csv(spark, f"{path}/nodes").where("labels is not null").agg(F.lit("nodes").alias("what"), F.count("*").alias("n"))
    rels = st.read_csv(spark, f"{path}/relationships").groupBy(F.col("type").alias("what")).agg(F.count("*").alias("n"))
    return nodes.unionByName(rels)


# --- keys ---------------------------------------------------------------------------------------------------------------------------


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a table of shipments, with an audit column, two candidates for the key, and a place that names few."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as transaction_id", "concat(l_orderkey, '-', l_partkey, '-', l_suppkey) as shipmentid", "CASE WHEN l_partkey % 3 = 0 THEN ' ' ELSE concat('L', l_orderkey, '-', l_partkey) END as lot_code", "l_suppkey as supplier_code",
    )


SHIPMENTS = "(SELECT l_orderkey AS a, l_orderkey || '-' || l_partkey || '-' || l_suppkey AS b, CASE WHEN l_partkey % 3 <> 0 THEN 'L' || l_orderkey || '-' || l_partkey END AS c, l_suppkey AS d FROM lineitem)"


@query(f"""SELECT c AS "class", k AS "key" FROM (SELECT 'ShipmentMaster' AS c, k, row_number() OVER (ORDER BY n DESC, place) AS r FROM (
SELECT 'shipmentid' AS k, count(DISTINCT b) AS n, 0 AS place FROM {SHIPMENTS} UNION ALL SELECT 'lot_code', count(DISTINCT c), 1 FROM {SHIPMENTS} UNION ALL SELECT 'supplier_code', count(DISTINCT d), 2 FROM {SHIPMENTS} UNION ALL SELECT 'transaction_id', count(DISTINCT a), 3 FROM {SHIPMENTS})) WHERE r = 1
UNION ALL SELECT 'Lot', CASE WHEN (SELECT count(DISTINCT c) FROM {SHIPMENTS}) >= (SELECT count(DISTINCT d) FROM {SHIPMENTS}) THEN 'lot_code' ELSE 'supplier_code' END""")
def detected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shipments(spark, sf_dir)
    found = [("ShipmentMaster", ig.detected_key(rows, "ShipmentMaster")), ("Lot", ig.detected_key(rows.select("lot_code", "supplier_code"), "Lot"))]
    return inline(spark, found, "class string, key string")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey || '_' || replace(o_orderpriority, ' ', '_') || CASE WHEN o_orderkey % 3 <> 0 THEN '_' || o_orderdate::DATE::VARCHAR ELSE '' END
WHEN o_orderkey % 2 = 0 THEN 'S' || o_orderkey || CASE WHEN o_orderkey % 3 <> 0 THEN '_' || o_orderdate::DATE::VARCHAR ELSE '' END
ELSE 'C' || o_custkey || CASE WHEN o_orderkey % 3 <> 0 THEN '_' || o_orderdate::DATE::VARCHAR ELSE '' END END AS name FROM orders""")
def row_keys_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer and priority; a fifth lack the priority and fall back to the sale's own id, and without that to the first code; two thirds have a time."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey as customer", "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority ELSE ' ' END as priority", "concat('C', o_custkey) as client_code", "CASE WHEN o_orderkey % 2 = 0 THEN concat('S', o_orderkey) END as saleid",
        "CASE WHEN o_orderkey % 3 <> 0 THEN cast(cast(o_orderdate as date) as string) END as made_date", "'x' as note",
    )
    columns = [c for c in rows.columns if c != "o_orderkey"]
    return rows.select("o_orderkey", ig.row_key(["customer", "priority"], c="SaleHistory", columns=columns).alias("name"))


# --- ranges -------------------------------------------------------------------------------------------------------------------------

BANDS = """WITH c AS (SELECT c_custkey, c_nationkey AS nation, c_acctbal AS reading FROM customer),
b AS (SELECT s_suppkey, s_nationkey AS nation, CASE WHEN s_suppkey % 11 <> 0 THEN s_acctbal - 500 END AS low, CASE WHEN s_suppkey % 13 <> 0 THEN s_acctbal + 250 * (s_suppkey % 5) - 600 * (s_suppkey % 7 = 0)::INT END AS high FROM supplier)"""


def _bands(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Readings of nations, and limits: some open on a side, some with the low above the high, of any width."""
    readings = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey as nation", "c_acctbal as reading")
    low, high = "CASE WHEN s_suppkey % 11 <> 0 THEN s_acctbal - 500 END as low", "CASE WHEN s_suppkey % 13 <> 0 THEN s_acctbal + 250 * (s_suppkey % 5) - 600 * cast(s_suppkey % 7 = 0 as int) END as high"
    return readings, table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_nationkey as nation", low, high)


@query(f"{BANDS} SELECT c_custkey, s_suppkey FROM c JOIN b USING (nation) WHERE (low IS NULL OR reading >= low) AND (high IS NULL OR reading < high)")
def range_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.range_join(*_bands(spark, sf_dir), ["nation"], "reading", "low", "high", closed="left").select("c_custkey", "s_suppkey")


@query(f"{BANDS} SELECT c_custkey, nation, reading FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.nation = c.nation AND (low IS NULL OR reading >= low) AND (high IS NULL OR reading <= high))")
def range_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.range_join(*_bands(spark, sf_dir), ["nation"], "reading", "low", "high", how="left_anti")


EPISODES = """WITH w AS (SELECT user_id, ts, ts + to_hours((1 + event_id % 60)::INT) AS until, event_id AS episode FROM events WHERE event_type = 'error'), v AS (SELECT event_id, user_id, ts AS moment FROM events WHERE event_type <> 'error')"""


@query(f"{EPISODES} SELECT episode, count(*) AS n FROM v JOIN w ON v.user_id = w.user_id AND moment > ts AND moment <= until GROUP BY episode")
def range_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in the hours after each of their errors, windows of one to sixty hours."""
    events = table(spark, sf_dir, "events")
    windows = events.where("event_type = 'error'").selectExpr("user_id", "ts as since", "ts + make_interval(0, 0, 0, 0, cast(1 + event_id % 60 as int)) as until", "event_id as episode")
    others = events.where("event_type <> 'error'").selectExpr("event_id", "user_id", "ts as at")
    return rg.range_join(others, windows, ["user_id"], "at", "since", "until", closed="right").groupBy("episode").agg(F.count("*").alias("n"))


# --- connectivity and chains --------------------------------------------------------------------------------------------------------

#: Links that the schema declares, besides those of the mapping: one of a class without instances, one that no edge has.
DECLARED = [*sg.OBJECT_PROPERTIES, ("supplies", "Supplier", "Part"), ("stores", "Depot", "Part"), ("servedBy", "Region", "Depot")]
PAIRS = [("Customer", "Supplier"), ("Order", "Region"), ("Order", "Supplier"), ("Supplier", "Part"), ("Depot", "Part"), ("Nation", "Part"), ("Region", "Customer"), ("Region", "Part"), ("Customer", "Ghost")]


@on_kept_graph(f""", l AS (SELECT * FROM (VALUES {_values(DECLARED)}) AS l(p, domain, "range")), pr AS (SELECT * FROM (VALUES {_values(PAIRS)}) AS pr(source, target)),
way AS (SELECT domain AS a, p, true AS fwd, "range" AS c FROM l UNION SELECT "range", p, false, domain FROM l),
walk AS (SELECT source, source AS node, 0 AS hops, []::STRUCT(p VARCHAR, fwd BOOLEAN, c VARCHAR)[] AS path, [source] AS seen FROM (SELECT DISTINCT source FROM pr)
  UNION ALL SELECT w.source, y.c, hops + 1, list_append(path, {{'p': y.p, 'fwd': y.fwd, 'c': y.c}}), list_append(seen, y.c) FROM walk w JOIN way y ON w.node = y.a WHERE hops < 3 AND NOT list_contains(seen, y.c)),
least AS (SELECT source, node, min(hops) AS hops FROM walk GROUP BY source, node),
best AS (SELECT w.source, w.node AS target, w.hops, w.path, w.source || array_to_string(list_transform(w.path, lambda x: CASE WHEN x.fwd THEN ' -' || x.p || '> ' ELSE ' <' || x.p || '- ' END || x.c), '') AS text
  FROM walk w JOIN least USING (source, node, hops) JOIN pr ON pr.source = w.source AND pr.target = w.node),
at_ AS (SELECT text, path, 0 AS k, node FROM best JOIN ty ON ty.c = best.source
  UNION SELECT a.text, a.path, a.k + 1, t2.node FROM at_ a JOIN e ON e.p = a.path[a.k + 1].p AND CASE WHEN a.path[a.k + 1].fwd THEN e.s ELSE e.o END = a.node
    JOIN ty t2 ON t2.node = CASE WHEN a.path[a.k + 1].fwd THEN e.o ELSE e.s END AND t2.c = a.path[a.k + 1].c WHERE a.k < len(a.path)),
n AS (SELECT text, k, count(DISTINCT node) AS n FROM at_ GROUP BY text, k),
st AS (SELECT text, unnest(range(1, hops + 1)) AS k FROM best),
rr AS (SELECT st.text, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY st.k) AS reached, min(st.k) FILTER (n IS NULL) AS failed FROM st LEFT JOIN n ON n.text = st.text AND n.k = st.k GROUP BY st.text),
r AS (SELECT pr.source, pr.target, b.text AS path, b.hops, (SELECT count(*) FROM ty WHERE c = pr.source) AS n_start, reached, failed
  FROM pr LEFT JOIN best b ON b.source = pr.source AND b.target = pr.target LEFT JOIN rr ON rr.text = b.text)
SELECT source, target, path, hops, n_start, reached, CASE WHEN path IS NULL THEN 'no_path' WHEN n_start = 0 THEN 'no_instances' WHEN failed IS NOT NULL THEN 'step ' || failed ELSE 'connected' END AS phase FROM r""")
def connectivity_queries(t: DataFrame, _: dict[str, DataFrame]) -> DataFrame:
    links, pairs = inline(t.sparkSession, DECLARED, "p string, domain string, range string"), inline(t.sparkSession, PAIRS, "source string, target string")
    found = ev.connectivity(t, links, pairs)
    return found.withColumn("reached", F.array_join(F.transform("reached", lambda n: n.cast("string")), ","))


CAUSES = "SELECT DISTINCT 'P' || s_suppkey % 40 AS cause, 'P' || (s_suppkey * 7 + s_suppkey // 40) % 40 AS effect, CASE WHEN s_acctbal > 4000 THEN 'up' ELSE 'down' END AS effect_dir FROM supplier"


@query(f"""WITH RECURSIVE r AS ({CAUSES}),
d AS (SELECT 'P1' AS node, 0 AS depth UNION SELECT r.effect, depth + 1 FROM d JOIN r ON r.cause = d.node WHERE depth < 40),
least AS (SELECT node, min(depth) AS depth FROM d GROUP BY node),
entered AS (SELECT 'P1' AS node, 0 AS depth, 'P1(change)' AS path, ['P1'] AS seen
  UNION ALL SELECT node, depth, path, seen FROM (SELECT l.node, l.depth, e.path || '>' || r.effect || '(' || r.effect_dir || ')' AS path, list_append(e.seen, r.effect) AS seen,
    row_number() OVER (PARTITION BY l.node ORDER BY e.path || '>' || r.effect || '(' || r.effect_dir || ')') AS k FROM entered e JOIN r ON r.cause = e.node JOIN least l ON l.node = r.effect AND l.depth = e.depth + 1) WHERE k = 1)
SELECT e.path || '>' || r.effect || '(' || r.effect_dir || ')' AS path, list_contains(e.seen, r.effect) AS cyclic FROM entered e JOIN r ON r.cause = e.node""")
def causal_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains from one of forty parameters, whose influences follow from the suppliers."""
    rules = table(spark, sf_dir, "supplier").selectExpr("concat('P', s_suppkey % 40) as cause", "concat('P', (s_suppkey * 7 + s_suppkey div 40) % 40) as effect", "CASE WHEN s_acctbal > 4000 THEN 'up' ELSE 'down' END as effect_dir").distinct()
    return ev.causal_chains(rules, "P1")


# --- blank nodes --------------------------------------------------------------------------------------------------------------------


@on_kept_graph(" SELECT count(*) AS n, true AS equal, false AS equal_changed FROM (SELECT DISTINCT s, p, o FROM g)")
def blank_digests(t: DataFrame, _: dict[str, DataFrame]) -> DataFrame:
    """The graph with its customers and nations as blank nodes, under two sets of labels, and with one edge turned: triples, and which digests are equal.

    Triples that name neither are the same in all three graphs, so their sums are made once.
    """
    blank = lambda c: F.col(c).startswith("Customer_") | F.col(c).startswith("Nation_")
    named = blank("s") | ((F.col("o_kind") == "iri") & blank("o"))

    def labelled(rows: DataFrame, prefix: str) -> DataFrame:
        to = lambda c: F.when(blank(c), F.concat(F.lit("_:"), F.md5(F.concat(F.lit(prefix), c)))).otherwise(F.col(c))
        own = rows.select(to("s").alias("s"), "p", F.when(F.col("o_kind") == "iri", to("o")).otherwise(F.col("o")).alias("o"), "o_kind")
        return own.withColumn("o_kind", F.when(F.col("o").startswith("_:"), "bnode").otherwise(F.col("o_kind")))

    told, plain = stored(t.where(named).select("s", "p", "o", "o_kind"), "told"), bl.sums(t.where(~named).select("s", "p", "o", "o_kind"))
    turned = told.withColumn("o", F.when((F.col("p") == "inRegion") & (F.col("s") == "Nation_0"), F.lit("Region_4")).otherwise(F.col("o")))
    one, two, other = (bl.digest(bl.sums(labelled(rows, prefix)), plain).select("n", F.col("digest").alias(name)) for rows, prefix, name in ((told, "a", "one"), (told, "b", "two"), (turned, "a", "other")))
    return one.join(two, "n").join(other, "n").select("n", (F.col("one") == F.col("two")).alias("equal"), (F.col("one") == F.col("other")).alias("equal_changed"))


# --- streams ------------------------------------------------------------------------------------------------------------------------

REPLAY = """WITH c AS (SELECT o_orderkey AS child, CASE WHEN o_orderkey % 97 = 0 THEN -o_orderkey WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS fk, 5000 + o_orderkey % 1000 AS minute FROM orders), m AS (SELECT c_custkey AS pk, c_custkey * 7 % 8000 AS minute FROM customer)"""


@query(f"{REPLAY} SELECT child, c.fk, m.pk AS master, CASE WHEN m.pk IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM c LEFT JOIN m ON c.fk = m.pk AND m.minute <= c.minute + 600")
def stream_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers replayed as streams: a third of the orders share a customer, and some customers come hours after their orders, or too late.

    A last event far ahead on either side lets the watermark pass, so the orders that still wait are reported.
    """
    path = _folder(spark, "replay")
    time = lambda c: F.timestamp_seconds(F.lit(1_704_067_200) + c.cast("long") * 60)
    key = "CASE WHEN o_orderkey % 97 = 0 THEN -o_orderkey WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END"
    children = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("child"), F.expr(key).cast("long").alias("fk"), time(F.lit(5000) + F.col("o_orderkey") % 1000).alias("at"))
    masters = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("pk"), time(F.col("c_custkey") * 7 % 8000).alias("since"))
    last = lambda names: spark.range(1).select(F.lit(None).cast("long").alias(names[0]), *[F.lit(-1).cast("long").alias(x) for x in names[1:-1]], time(F.lit(10_000_000)).alias(names[-1]))
    for name, rows, end in (("children", children, last(["child", "fk", "at"])), ("masters", masters, last(["pk", "since"]))):
        rows.write.parquet(f"{path}/{name}")
        end.write.mode("append").parquet(f"{path}/{name}")
    streams = [spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(f"{path}/{name}") for name, rows in (("children", children), ("masters", masters))]
    out = run_to_table(resolved_references(*streams, "600 minutes", "10000 minutes", salts=8), f"{path}/out")
    return out.where("child is not null").select("child", "fk", "master", "status")
