"""Repairs of a graph that breaks shapes: for each violation the cheapest feasible one, validated again until nothing moves, with a log of each change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.coercion import to_boolean, to_integer, to_number, to_timestamp
from graphloom.storage import discard, stored

COLUMNS = ["s", "p", "o", "o_kind", "o_dt"]
#: What a change costs: a value in another form, one of several kept, a value or type added, a value lost.
COSTS = {"cast": 1, "choose": 1, "add": 2, "drop": 5}
VIOLATION = ["shape", "kind", "s", "p", "o", "o_kind", "o_dt"]
LOG = ["shape", "action", "s", "p", "o", "new", "new_dt"]


def converted(value: Column, dt: Column) -> Column:
    """The usual text of a value in a data type; null where it has none. Another data type takes any text."""
    number = to_number(value)
    decimal = F.when(~F.isnan(number), number.try_cast("decimal(38,6)").cast("string"))
    plain = F.regexp_replace(F.regexp_replace(decimal, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    stamp = F.date_format(to_timestamp(value), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(dt == "decimal", plain).when(dt == "integer", to_integer(value).cast("string")).when(dt == "boolean", to_boolean(value).cast("string")).when(dt == "dateTime", stamp).otherwise(value)


def _names(shapes: DataFrame, column: str, *kinds: str) -> list[str]:
    """What shapes (of some kinds) name in a column; read on the driver, as shapes are a schema's."""
    return sorted({r[0] for r in shapes.where(F.col("kind").isin(*kinds)).select(column).collect() if r[0] is not None})


def violations(t: DataFrame, shapes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """shape, kind, s, p, o, o_kind, o_dt, value, fallback of what breaks shapes (shape, c, p, kind, value, fallback) of a class c.

    kind datatype: a literal that is not of data type value; class: a node that is not of class value (types as stated); max and min: more or
    fewer than value different values, for max a row for each value beyond, those kept being of the right data type first, then the least; for min a row without a value.
    t: all triples of the nodes to judge; known: a table with the types of what they point to, t itself unless given. A value is judged before it is
    asked whether its node has the class, so only what may break a shape meets the types.
    """
    types = t.where((F.col("p") == "type") & F.col("o").isin(_names(shapes, "c", "datatype", "class", "max", "min"))).select("s", F.col("o").alias("c"))
    own = lambda *kinds: t.where((F.col("p") != "type") & F.col("p").isin(_names(shapes, "p", *kinds))).select(*COLUMNS)
    of_kind = lambda kind: shapes.where(F.col("kind") == kind)
    in_class = lambda df: df.join(types, ["s", "c"], "left_semi").drop("c").distinct()
    literal = own("datatype").where("o_kind = 'lit'").join(of_kind("datatype"), "p")
    wrong = in_class(literal.where(~F.col("o_dt").eqNullSafe(F.col("value")) | converted(F.col("o"), F.col("value")).isNull()))
    of = (t if known is None else known).where((F.col("p") == "type") & F.col("o").isin(_names(shapes, "value", "class"))).select(F.col("s").alias("o"), F.col("o").alias("value"))
    unfit = in_class(own("class").where("o_kind = 'iri'").join(of_kind("class"), "p").join(of, ["o", "value"], "left_anti"))
    values = own("max", "min").repartition("s", "p").distinct()
    counts = values.groupBy("s", "p").agg(F.count("*").alias("_n"))
    crowded = in_class(counts.join(of_kind("max"), "p").where(F.col("_n") > F.col("value").try_cast("int")).drop("_n"))
    dts = shapes.where("kind = 'datatype'").select("p", F.col("value").alias("dt")).groupBy("p").agg(F.min("dt").alias("dt"))
    many = values.join(crowded, ["s", "p"]).join(dts, "p", "left")
    badly = F.col("dt").isNotNull() & (~F.col("o_dt").eqNullSafe(F.col("dt")) | converted(F.col("o"), F.col("dt")).isNull())
    place = F.row_number().over(Window.partitionBy("shape", "s", "p", "value", "fallback").orderBy(badly, "o", "o_kind", "o_dt"))
    beyond = many.withColumn("_place", place).where(F.col("_place") > F.col("value").try_cast("int")).drop("_place", "dt")
    few = types.join(of_kind("min"), "c").drop("c").join(counts, ["s", "p"], "left")
    few = few.where(F.coalesce("_n", F.lit(0)) < F.col("value").try_cast("int")).drop("_n").distinct()
    few = few.withColumns({c: F.lit(None).cast("string") for c in ("o", "o_kind", "o_dt")})
    return reduce(DataFrame.unionByName, [x.select(*VIOLATION, "value", "fallback") for x in (wrong, unfit, beyond, few)])


def candidates(found: DataFrame, t: DataFrame, shapes: DataFrame, disjoint: DataFrame | None, infer_types: bool) -> DataFrame:
    """The feasible repairs of violations: action, cost, new and new_dt with each.

    datatype: cast, where the value has a form in the type, or drop. max: choose, that is drop the value beyond. min: add the fallback, in the
    property's data type. class: with infer_types, add the type, unless the node has one that is disjoint (a, b) with it; without, nothing.
    """
    rest = found.columns
    none = F.lit(None).cast("string")
    made = lambda df, action, new=none, dt=none: df.select(*rest, F.lit(action).alias("action"), new.alias("new"), dt.alias("new_dt"))
    types = shapes.where("kind = 'datatype'").groupBy("p").agg(F.min("value").alias("_dt"))
    wrong = found.where("kind = 'datatype'")
    cast = converted(F.col("o"), F.col("value"))
    rows = [made(wrong.where(cast.isNotNull()), "cast", cast, F.col("value")), made(wrong, "drop"), made(found.where("kind = 'max'"), "choose")]
    rows.append(made(found.where("kind = 'min' and fallback is not null").join(types, "p", "left"), "add", F.col("fallback"), F.col("_dt")))
    if infer_types:
        unfit = found.where("kind = 'class'")
        if disjoint is not None:
            held = t.where("p = 'type'").select(F.col("s").alias("o"), F.col("o").alias("a"))
            apart = disjoint.select("a", "b").union(disjoint.select("b", "a")).distinct()
            unfit = unfit.join(held.join(apart, "a").select("o", F.col("b").alias("value")).distinct(), ["o", "value"], "left_anti")
        rows.append(made(unfit, "add", F.col("value")))
    cost = F.create_map(*[F.lit(x) for kv in COSTS.items() for x in kv])
    return reduce(DataFrame.unionByName, rows).withColumn("cost", cost[F.col("action")])


def repaired(t: DataFrame, shapes: DataFrame, disjoint: DataFrame | None = None, infer_types: bool = False, kept: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graph, log, rest): the repaired triples (s, p, o, o_kind, o_dt), each change (round, shape, action, s, p, o, new, new_dt), and the violations without a repair.

    Each round gives every violation its cheapest repair (COSTS; by name on ties); of several for one value the least by shape counts, so a value changes
    once a round. Rounds go on while a repair changes the graph, and a change is made once only, so they end: a value that a shape gets by its fallback
    and loses by another stays lost. No violation is left in rest that has a repair which was not tried.

    Only the properties that shapes name are judged. The whole of them is judged once; a later round judges the nodes that the last one touched: those that
    changed, and with infer_types those that got a type and what points to them. Their triples are kept apart, the others stay as given. kept: t is read from a table that
    stays; else what is judged is stored first.
    """
    judged = F.coalesce(F.col("p").isin(["type", *_names(shapes, "p", "datatype", "class", "max", "min")]), F.lit(False))
    base = t.where(judged).select(*COLUMNS) if kept else stored(t.where(judged).select(*COLUMNS).distinct(), "shaped")
    moved, dirty, known = base.limit(0), None, base
    found = fresh = stored(violations(base, shapes), "violations")
    log: list[DataFrame] = []
    while True:
        ways = candidates(fresh, known, shapes, disjoint, infer_types)
        best = Window.partitionBy("s", "p", "o", "o_kind", "o_dt", F.when(F.col("action") == "add", F.col("shape"))).orderBy("cost", "action", "shape", "new")
        chosen = ways.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*LOG, "kind", "o_kind", "o_dt")
        done = reduce(DataFrame.unionByName, log).drop("round") if log else None
        if done is not None:
            same = reduce(lambda x, y: x & y, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in LOG])
            chosen = chosen.alias("x").join(done.alias("y"), same, "left_anti")
        chosen = stored(chosen, "repairs")
        if chosen.isEmpty():
            other = t.where(~judged).select(*COLUMNS)
            graph = (base if dirty is None else base.join(dirty, "s", "left_anti").unionByName(moved)).unionByName(other).distinct()
            empty = chosen.select(F.lit(0).alias("round"), *LOG)
            return graph, reduce(DataFrame.unionByName, log) if log else empty, found.select("shape", "kind", "s", "p", "o")
        log.append(chosen.select(F.lit(len(log) + 1).alias("round"), *LOG))
        typed = (F.col("action") == "add") & (F.col("kind") == "class")
        touched = chosen.where(~typed).select("s")
        if infer_types:
            retyped = chosen.where(typed).select("o").distinct()
            pointing = base.unionByName(moved).where("o_kind = 'iri' and p <> 'type'").join(retyped, "o", "left_semi").select("s")
            touched = touched.union(retyped).union(pointing)
        touched = stored(touched.distinct(), "touched")
        first = touched if dirty is None else stored(touched.join(dirty, "s", "left_anti"), "touched")
        was = moved if first.isEmpty() else moved.unionByName(base.join(first, "s", "left_semi").distinct())
        lost = chosen.where("action in ('cast', 'drop', 'choose')").select("s", "p", "o", "o_kind", "o_dt").distinct()
        on = reduce(lambda x, y: x & y, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in COLUMNS])
        left = was.alias("x").join(lost.alias("y"), on, "left_anti")
        values = chosen.where("action = 'cast' or (action = 'add' and kind = 'min')").select("s", "p", F.col("new").alias("o"), F.lit("lit").alias("o_kind"), F.col("new_dt").alias("o_dt"))
        types = chosen.where(typed).select(F.col("o").alias("s"), F.lit("type").alias("p"), F.col("new").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"))
        now = stored(left.unionByName(values).unionByName(types).distinct(), "moved")
        dirty, before = (first if dirty is None else stored(dirty.union(first), "dirty")), (moved, dirty, first, found, fresh)
        known = base.unionByName(now) if infer_types else base  # types are only added
        fresh = stored(violations(now.join(touched, "s", "left_semi"), shapes, known), "violations")
        found = stored(found.join(touched, "s", "left_anti").unionByName(fresh), "violations")
        discard(*(x for x in (*before, touched) if x is not dirty))
        moved = now
