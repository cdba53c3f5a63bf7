"""Contradictions of a graph with its schema, and the minimal sets of axioms that cause each.

What an instance is follows from what is said of it: its types, the properties that it is the subject or object of, and its literals' data types.
Each such statement is a state; axioms lead from state to state. A fixpoint over the schema carries with each derived state the
sets of axioms used, minimal ones only. It never meets instances: those are joined once with the pairs of statements that contradict each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.storage import discard, stored

#: Kinds of axioms (axiom, kind, a, b): what a and b are.
KINDS = {
    "subclass": "class, class above",
    "equivalent_class": "class, class",
    "subproperty": "property, property above",
    "inverse": "property, property",
    "symmetric": "property",
    "domain": "property, class",
    "range": "property, class",
    "disjoint": "class, class",
    "functional": "property; two different literals contradict it",
    "datatype": "property, data type of its literals",
}
NOTHING = "Nothing"
STATE = ["kind", "name", "dt"]


def _state(prefix: str, kind: Column | str, name: str) -> list[Column]:
    return [(F.lit(kind) if isinstance(kind, str) else kind).alias(f"{prefix}_kind"), F.col(name).alias(f"{prefix}_name")]


def transitions(axioms: DataFrame) -> DataFrame:
    """axiom, a_kind, a_name, b_kind, b_name: what follows from a state of an instance: class, out (subject of), in (object of), lit (subject of, with a literal)."""

    def made(kind: str, *steps: tuple[str, str, str, str]) -> list[DataFrame]:
        own = axioms.where(F.col("kind") == kind)
        return [own.select("axiom", *_state("a", k, x), *_state("b", m, y)) for k, x, m, y in steps]

    parts = made("subclass", ("class", "a", "class", "b"))
    parts += made("equivalent_class", ("class", "a", "class", "b"), ("class", "b", "class", "a"))
    parts += made("subproperty", *[(k, "a", k, "b") for k in ("out", "in", "lit")])
    parts += made("inverse", ("out", "a", "in", "b"), ("in", "a", "out", "b"), ("out", "b", "in", "a"), ("in", "b", "out", "a"))
    parts += made("symmetric", ("out", "a", "in", "a"), ("in", "a", "out", "a"))
    parts += made("domain", ("out", "a", "class", "b"), ("lit", "a", "class", "b"))
    parts += made("range", ("in", "a", "class", "b"))
    return reduce(DataFrame.unionByName, parts)


def least_sets(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows without those whose axioms hold all axioms of another row of the same key, and fewer are enough; equal rows become one."""
    rows = rows.dropDuplicates([*key, "axioms"])
    other = rows.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("axioms").alias("_axioms"))
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], F.lit(True))
    smaller = (F.size("_axioms") < F.size("axioms")) & (F.size(F.array_except("_axioms", "axioms")) == 0)
    return rows.join(other, on & smaller, "left_anti")


def derived_states(states: DataFrame, axioms: DataFrame) -> DataFrame:
    """item, kind, name, dt, axioms: each state that a given one (kind, name, dt; dt for literals) leads to, itself too, by each minimal set of axioms.

    item is the given state. Each round follows the axioms from what the last one found; a set that holds one already known for the same item and
    state is not followed, so cycles end.
    """
    steps = stored(transitions(axioms), "transitions")
    start = states.select(*STATE).distinct().select(F.struct(*STATE).alias("item"), *STATE, F.array().cast("array<string>").alias("axioms"))
    rounds = [stored(start, "states")]
    key = ["item", *STATE]
    while not rounds[-1].isEmpty():
        on = (F.col("kind") == F.col("a_kind")) & (F.col("name") == F.col("a_name"))
        to = rounds[-1].join(steps, on).select(
            "item", F.col("b_kind").alias("kind"), F.col("b_name").alias("name"), F.when(F.col("b_kind") == "lit", F.col("dt")).alias("dt"),
            F.array_sort(F.array_union("axioms", F.array("axiom"))).alias("axioms"),
        )
        known = reduce(DataFrame.unionByName, rounds).select(*[F.col(c).alias(f"_{c}") for c in (*key, "axioms")])
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
        fresh = least_sets(to, key).join(known, same & (F.size(F.array_except("_axioms", "axioms")) == 0), "left_anti")
        rounds.append(stored(fresh, "states"))
    out = stored(least_sets(reduce(DataFrame.unionByName, rounds), key), "states")
    discard(steps, *rounds)
    return out


def contradictions(states: DataFrame, axioms: DataFrame) -> DataFrame:
    """clash, item, other, axioms: pairs of given states that contradict each other, by each minimal set of axioms; a state that contradicts itself is its own other.

    clash is nothing, disjoint, datatype, or functional, for which the two literals must differ.
    """
    own = derived_states(states, axioms)
    classes = own.where("kind = 'class'").select("item", "name", "axioms")
    literals = own.where("kind = 'lit'").select("item", "name", "dt", "axioms")
    renamed = lambda df: df.select(*[F.col(c).alias({"item": "other", "axioms": "more"}.get(c, f"_{c}")) for c in df.columns])
    told = lambda clash, *parts: (F.lit(clash).alias("clash"), "item", "other", F.array_sort(F.array_distinct(F.concat(*parts))).alias("axioms"))
    apart = axioms.where("kind = 'disjoint'").select("axiom", "a", "b")
    nothing = classes.where(F.col("name") == NOTHING).withColumn("other", F.col("item")).select(*told("nothing", "axioms"))
    disjoint = classes.join(apart, F.col("name") == F.col("a")).join(renamed(classes), F.col("b") == F.col("_name")).select(*told("disjoint", "axioms", "more", F.array("axiom")))
    types = axioms.where("kind = 'datatype'").select("axiom", "a", "b")
    typed = literals.join(types, (F.col("name") == F.col("a")) & ~F.col("dt").eqNullSafe(F.col("b"))).withColumn("other", F.col("item")).select(*told("datatype", "axioms", F.array("axiom")))
    single = axioms.where("kind = 'functional'").select("axiom", "a")
    twice = literals.join(single, F.col("name") == F.col("a")).join(renamed(literals), F.col("name") == F.col("_name")).select(*told("functional", "axioms", "more", F.array("axiom")))
    rows = reduce(DataFrame.unionByName, [nothing, disjoint, typed, twice])
    ordered = rows.select("clash", F.least("item", "other").alias("item"), F.greatest("item", "other").alias("other"), "axioms")
    return least_sets(ordered, ["clash", "item", "other"])


def statements(t: DataFrame) -> DataFrame:
    """s, kind, name, dt, low, high: what is said of each subject and object, each once, with the least and greatest literal. o_dt is a literal's data type, if there."""
    dt = F.col("o_dt") if "o_dt" in t.columns else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    types = t.where("p = 'type'").select("s", F.lit("class").alias("kind"), F.col("o").alias("name"), none.alias("dt"), none.alias("o"))
    links = t.where("p <> 'type' and o_kind = 'iri'")
    out = links.select("s", F.lit("out").alias("kind"), F.col("p").alias("name"), none.alias("dt"), none.alias("o"))
    into = links.select(F.col("o").alias("s"), F.lit("in").alias("kind"), F.col("p").alias("name"), none.alias("dt"), none.alias("o"))
    told = t.where("p <> 'type' and o_kind = 'lit'").select("s", F.lit("lit").alias("kind"), F.col("p").alias("name"), dt.alias("dt"), "o")
    rows = reduce(DataFrame.unionByName, [types, out, into, told])
    return rows.groupBy("s", *STATE).agg(F.min("o").alias("low"), F.max("o").alias("high"))


def clashes(t: DataFrame, axioms: DataFrame) -> DataFrame:
    """s, clash, axioms: each subject or object that contradicts the schema, by each minimal set of axioms for its statements.

    Different literals are taken for different values; different IRIs are not, so functional object properties don't clash. Statements
    are put together by subject first, so a common one is a row; only those that are part of a contradiction are joined, with another of the same
    subject.
    """
    said = stored(statements(t), "statements")
    pairs = stored(contradictions(said.select(*STATE).distinct(), axioms), "contradictions")
    item = said.select("s", F.struct(*STATE).alias("item"), "low", "high")
    parts = pairs.select("item").union(pairs.select("other")).distinct()
    held = item.join(parts, "item", "left_semi")
    first = held.join(pairs, "item")
    second = held.select("s", F.col("item").alias("other"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    both = first.join(second, ["s", "other"])
    same_one = F.col("item") == F.col("other")
    one_value = (F.col("low") == F.col("high")) & (F.col("_low") == F.col("_high")) & (F.col("low") == F.col("_low")) & F.col("item.dt").eqNullSafe(F.col("other.dt"))
    differ = F.when(same_one, F.col("low") < F.col("high")).otherwise(~one_value)
    found = both.where((F.col("clash") != "functional") | differ).select("s", "clash", "axioms").distinct()
    return found


def inconsistent_axioms(t: DataFrame, axioms: DataFrame) -> DataFrame:
    """axioms, clash, n, example: the minimal sets of axioms that contradict the graph, with the kinds of contradiction (joined by ,), the number of nodes that show it, and the least.

    A graph is consistent with the axioms, in these kinds of contradiction, if there is none. No set holds another, and leaving out any axiom of
    each set makes the graph consistent with the rest of the axioms that stay.
    """
    found = clashes(t, axioms).groupBy("axioms").agg(F.array_join(F.sort_array(F.collect_set("clash")), ",").alias("clash"), F.count_distinct("s").alias("n"), F.min("s").alias("example"))
    return least_sets(stored(found, "inconsistent").withColumn("all", F.lit(1)), ["all"]).drop("all")


def unsatisfiable_classes(axioms: DataFrame) -> DataFrame:
    """class, axioms: classes that can have no instance, by each minimal set of axioms."""
    names = [axioms.where(F.col("kind").isin("subclass", "equivalent_class", "disjoint")).select(F.explode(F.array("a", "b")).alias("name"))]
    names += [axioms.where(F.col("kind").isin("domain", "range")).select(F.col("b").alias("name"))]
    given = reduce(DataFrame.union, names).where(F.col("name") != NOTHING).distinct()
    states = given.select(F.lit("class").alias("kind"), "name", F.lit(None).cast("string").alias("dt"))
    own = contradictions(states, axioms).where(F.col("item") == F.col("other")).select(F.col("item.name").alias("class"), "axioms")
    return least_sets(own, ["class"])
