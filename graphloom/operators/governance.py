"""Schema constraints, generated tests, profiles, origins of statements, and metrics as triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.analytics import lpg_rels
from graphloom.operators.reasoning import superclasses

#: Which origins state what is closed (recorded), open (said by people or models) or inferred.
ORIGINS = {"csv_direct": "cwa", "manual": "cwa", "tacit_sme": "owa", "model": "owa", "owl_rl_1hop": "inferred", "owl_rl_chain": "inferred"}
#: Axioms that a profile of the ontology language leaves out.
EL_LACKS = ("all_values", "inverse", "symmetric", "functional", "inverse_functional", "max_cardinality", "min_cardinality", "union", "complement", "asymmetric", "irreflexive")
QL_LACKS = ("all_values", "chain", "transitive", "functional", "inverse_functional", "has_key", "has_value", "same_as", "max_cardinality", "min_cardinality", "union", "one_of")
RL_LACKS = ("disjoint_union", "reflexive", "min_cardinality", "union_superclass", "some_values_superclass")


def ontoclean(meta: DataFrame, subclass: DataFrame) -> DataFrame:
    """rule, subclass, parent of subclass pairs (a, b) that break a constraint of meta properties (c, rigidity, unity, identity): a + class under a - one."""
    of = lambda name, side: meta.select(F.col("c").alias(name), *[F.col(k).alias(f"{side}_{k}") for k in ("rigidity", "unity", "identity")])
    both = subclass.select("a", "b").distinct().join(of("a", "sub"), "a").join(of("b", "up"), "b")
    marks = (("C1_rigidity", "rigidity", "R"), ("C2_unity", "unity", "U"), ("C3_identity", "identity", "I"))
    rows = [both.where((F.col(f"sub_{k}") == f"+{x}") & (F.col(f"up_{k}") == f"-{x}")).select(F.lit(rule).alias("rule"), F.col("a").alias("subclass"), F.col("b").alias("parent")) for rule, k, x in marks]
    return reduce(DataFrame.unionByName, rows)


def language_profiles(axioms: DataFrame) -> DataFrame:
    """profile, fits, n_outside of axioms (kind): whether a schema stays within EL, QL and RL, and how many of its axioms don't."""
    rows = [axioms.agg(F.count_if(F.col("kind").isin(*lacks)).alias("n_outside")).select(F.lit(name).alias("profile"), (F.col("n_outside") == 0).alias("fits"), "n_outside") for name, lacks in (("EL", EL_LACKS), ("QL", QL_LACKS), ("RL", RL_LACKS))]
    return reduce(DataFrame.unionByName, rows)


def generated_tests(t: DataFrame, domain: DataFrame, range_: DataFrame, datatypes: DataFrame, functional: list[str], inverse_functional: list[str], subclass: DataFrame) -> DataFrame:
    """test, p, n_checked, n_bad of a test for each property and axiom, over all rows: domain and range (p, c; typed nodes, subclasses counted), datatype (p, dt; of o_dt), functional both ways."""
    up = superclasses(subclass).select(F.col("a").alias("c"), F.col("b").alias("above"))
    ty = t.where("p = 'type'").select(F.col("s").alias("node"), F.col("o").alias("c")).distinct()
    closed = ty.join(up, "c").select("node", F.col("above").alias("c")).unionByName(ty).distinct().withColumn("hit", F.lit(True))
    typed = ty.select("node").distinct()

    def classed(name: str, who: str, axis: DataFrame) -> DataFrame:
        own = t.join(axis, "p").select("p", F.col(who).alias("node"), "c").distinct().join(typed, "node", "left_semi").join(closed, ["node", "c"], "left")
        return own.select(F.lit(name).alias("test"), "p", F.col("hit").isNull().alias("bad"))

    def single(name: str, who: str, other: str, properties: list[str]) -> DataFrame:
        return t.where(F.col("p").isin(properties)).groupBy("p", who).agg((F.count_distinct(other) > 1).alias("bad")).select(F.lit(name).alias("test"), "p", "bad")

    told = t.where("o_kind = 'lit'").join(datatypes, "p").select(F.lit("datatype").alias("test"), "p", F.coalesce(F.col("o_dt") != F.col("dt"), F.lit(True)).alias("bad"))
    rows = [classed("domain", "s", domain), classed("range", "o", range_), told, single("functional", "s", "o", functional), single("inverse_functional", "o", "s", inverse_functional)]
    return reduce(DataFrame.unionByName, rows).groupBy("test", "p").agg(F.count("*").alias("n_checked"), F.count_if("bad").alias("n_bad"))


def tagged_origin(t: DataFrame, origin: str) -> DataFrame:
    """The triples with their origin, one of ORIGINS; blank-node subjects go."""
    if origin not in ORIGINS:
        raise ValueError(f"origin must be one of {sorted(ORIGINS)}")
    return t.where(~F.col("s").startswith("_:")).withColumn("origin", F.lit(origin))


def origin_summary(statements: DataFrame) -> DataFrame:
    """category, n of statements (origin): cwa, owa or inferred; null for an unknown origin."""
    kinds = F.create_map(*[F.lit(x) for kv in ORIGINS.items() for x in kv])
    return statements.groupBy(F.try_element_at(kinds, "origin").alias("category")).agg(F.count("*").alias("n"))


def measurements(metrics: DataFrame, computed_on: str) -> DataFrame:
    """Triples (s, p, o) of metrics (metric, value) as quality measurements of a data set."""
    s = F.concat(F.lit(f"{computed_on}/measurement/"), "metric")
    rows = F.array(*[F.struct(F.lit(p).alias("p"), o.cast("string").alias("o")) for p, o in (("type", F.lit("QualityMeasurement")), ("computedOn", F.lit(computed_on)), ("isMeasurementOf", F.col("metric")), ("value", F.col("value")))])
    return metrics.select(s.alias("s"), F.explode(rows).alias("x")).select("s", "x.p", "x.o")


def graph_context(rels: DataFrame, main: DataFrame) -> DataFrame:
    """rels (start, end, type) with context: main where the main graph's rels have them, else inferred."""
    known = main.select("start", "end", "type", F.lit(True).alias("hit")).distinct()
    return rels.join(known, ["start", "end", "type"], "left").select("start", "end", "type", F.when(F.col("hit"), "main").otherwise("inferred").alias("context"))


def property_graph_check(t: DataFrame, nodes: DataFrame, rels: DataFrame, flipped: DataFrame) -> DataFrame:
    """what, expected, found, lost of a property graph against its triples: nodes, relationships (loops and the second direction of inverse pairs (p, q) apart) and property values."""
    due = [("nodes", t.where("p = 'type' or o_kind = 'lit'").select("s").distinct()), ("relationships", lpg_rels(t, flipped)), ("values", t.where("o_kind = 'lit'").select("s", "p", "o").distinct())]
    values = nodes.where("props is not null").select(F.explode(F.map_values("props")).alias("v")).select(F.explode("v").alias("v"))
    count = lambda df, what, name: df.agg(F.count("*").alias(name)).select(F.lit(what).alias("what"), name)
    expected = reduce(DataFrame.unionByName, [count(df, what, "expected") for what, df in due])
    found = reduce(DataFrame.unionByName, [count(df, what, "found") for what, df in (("nodes", nodes), ("relationships", rels), ("values", values))])
    return expected.join(found, "what").select("what", "expected", "found", F.greatest(F.col("expected") - F.col("found"), F.lit(0)).alias("lost"))
