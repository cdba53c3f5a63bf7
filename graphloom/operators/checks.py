"""Graph checks. Each returns one row: check, applicable, n_checked, n_bad, passed; a check that doesn't apply stays apart from one that passes.

A check passes if its share of bad rows is at most a stated one, none unless given; all bad rows are counted. The share is a parameter, as the
survey's thresholds are policy: 0.05 for outliers and unresolved keys, 0.15 for foreign keys without a property, else by the tier of a class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import quantiles as qu
from graphloom.operators.reasoning import superclasses
from graphloom.operators.rules import indexed
from graphloom.storage import stored

#: Strings that stand for a missing value, and shares of bad rows under which a check passes.
INVALID_STRINGS = ("n/a", "na", "null", "undefined", "none", "nan", "-", "")
FEW, MOST_KEYS = 0.05, 0.15


def _row(name: str, df: DataFrame, checked: Column, bad: Column, allowed: float = 0.0) -> DataFrame:
    counted = df.agg(checked.cast("long").alias("n_checked"), F.coalesce(bad, F.lit(0)).cast("long").alias("n_bad"))
    return counted.select(F.lit(name).alias("check"), (F.col("n_checked") > 0).alias("applicable"), "n_checked", "n_bad", (F.col("n_bad") <= F.col("n_checked") * allowed).alias("passed"))


def _flagged(name: str, df: DataFrame, allowed: float = 0.0) -> DataFrame:
    """Of a frame with a boolean column bad."""
    return _row(name, df, F.count("*"), F.count_if("bad"), allowed)


def samples(df: DataFrame, most: int = 20) -> DataFrame:
    """The first bad rows of a frame with a boolean column bad, by all its columns; for reports, whose counts cover all rows."""
    return df.where("bad").drop("bad").orderBy(*[c for c in df.columns if c != "bad"]).limit(most)


def _types(t: DataFrame) -> DataFrame:
    return t.where("p = 'type'").select(F.col("s").alias("node"), F.col("o").alias("c")).distinct()


def _edges(t: DataFrame) -> DataFrame:
    return t.where("o_kind = 'iri' and p <> 'type'").select("s", "p", "o")


def _absent(df: DataFrame, column: str, known: DataFrame, name: str) -> DataFrame:
    """df with bad where column isn't among known's nodes."""
    hit = known.select(F.col("node").alias(column), F.lit(True).alias("hit")).distinct()
    return df.join(hit, column, "left").withColumn(name, F.col("hit").isNull()).drop("hit")


def bidirectional(t: DataFrame, inverse: DataFrame) -> DataFrame:
    """Edges of inverse pairs without their counterpart, both directions."""
    both = inverse.unionByName(inverse.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct()
    own = _edges(t).join(both, "p")
    back = _edges(t).select(F.col("o").alias("s"), F.col("p").alias("q"), F.col("s").alias("o"), F.lit(True).alias("hit"))
    return _flagged("bidirectional", own.join(back, ["s", "q", "o"], "left").withColumn("bad", F.col("hit").isNull()))


def flow_ends(t: DataFrame, p: str) -> DataFrame:
    """node, place of a flow's start nodes (nothing leads to them) and end nodes (nothing leads on)."""
    e = t.where((F.col("p") == p) & (F.col("o_kind") == "iri"))
    sources, targets = e.select(F.col("s").alias("node")).distinct(), e.select(F.col("o").alias("node")).distinct()
    return sources.join(targets, "node", "left_anti").withColumn("place", F.lit("start")).unionByName(targets.join(sources, "node", "left_anti").withColumn("place", F.lit("end")))


def process_flow(t: DataFrame, p: str, step_class: str) -> DataFrame:
    """A flow of steps (instances of a class) linked by a property: n_checked steps and links; bad without two steps and one link. Without either it doesn't apply."""
    steps = t.where((F.col("p") == "type") & (F.col("o") == step_class)).select("s").distinct().select(F.lit(1).alias("step"), F.lit(0).alias("link"))
    links = t.where((F.col("p") == p) & (F.col("o_kind") == "iri")).select(F.lit(0).alias("step"), F.lit(1).alias("link"))
    n_steps, n_links = F.coalesce(F.sum("step"), F.lit(0)), F.coalesce(F.sum("link"), F.lit(0))
    return _row("process_flow", steps.unionByName(links), n_steps + n_links, F.when((n_steps + n_links > 0) & ((n_steps < 2) | (n_links < 1)), 1).otherwise(0))


def orphan(t: DataFrame) -> DataFrame:
    """Typed instances without an edge in or out."""
    ends = _edges(t).select(F.col("s").alias("node")).union(_edges(t).select(F.col("o").alias("node")))
    return _flagged("orphan", _absent(_types(t).select("node").distinct(), "node", ends, "bad"))


def class_count(t: DataFrame, classes: DataFrame, excused: list[str] | None = None) -> DataFrame:
    """Declared classes (c) without instances, but for excused ones (that only inference fills)."""
    classes = classes.where(~F.col("c").isin(excused or [""]))
    held = _types(t).select("c", F.lit(True).alias("hit")).distinct()
    return _flagged("class_count", classes.join(held, "c", "left").withColumn("bad", F.col("hit").isNull()))


def fk_ref(t: DataFrame) -> DataFrame:
    """Distinct edges whose target has no type."""
    return _flagged("fk_ref", _absent(_edges(t).distinct(), "o", _types(t), "bad"))


def inference(raw: DataFrame, inferred: DataFrame | None) -> DataFrame:
    """Inference added something: bad if not; not applicable without an inferred graph."""
    n = raw.agg(F.count("*").alias("raw"))
    m = (inferred if inferred is not None else raw.limit(0)).agg(F.count("*").alias("inferred"))
    return n.crossJoin(m).select(F.lit("inference").alias("check"), (F.col("inferred") > 0).alias("applicable"), F.col("inferred").alias("n_checked"), ((F.col("inferred") > 0) & (F.col("inferred") <= F.col("raw"))).cast("long").alias("n_bad")).withColumn("passed", F.col("n_bad") == 0)


def _compatible(t: DataFrame, who: str, axis: DataFrame, subclass: DataFrame) -> DataFrame:
    up = superclasses(subclass).select(F.col("a").alias("c"), F.col("b").alias("super"))
    ty = _types(t)
    closed = ty.join(up, "c").select("node", F.col("super").alias("c")).unionByName(ty).distinct()
    own = t.join(axis.where("c <> 'Thing'"), "p").where("p <> 'type'").select("s", "p", "o", F.col(who).alias("node"), "c").distinct()
    typed = own.join(ty.select("node").distinct(), "node", "left_semi")
    return typed.join(closed.withColumn("hit", F.lit(True)), ["node", "c"], "left").withColumn("bad", F.col("hit").isNull())


def domain_axis(t: DataFrame, domain: DataFrame, subclass: DataFrame) -> DataFrame:
    """Triples with a typed subject outside the property's domain, superclasses counted."""
    return _flagged("domain", _compatible(t, "s", domain, subclass))


def range_axis(t: DataFrame, range_: DataFrame, subclass: DataFrame) -> DataFrame:
    return _flagged("range", _compatible(t.where("o_kind = 'iri'"), "o", range_, subclass))


def schema_ref(schema: DataFrame, declared: DataFrame) -> DataFrame:
    """Terms that schema rows (term) refer to but nothing declares (node)."""
    return _flagged("schema_ref", _absent(schema.select("term").distinct(), "term", declared, "bad"))


def existential(t: DataFrame, axioms: DataFrame) -> DataFrame:
    """Members of a class without any value of a property it must have; axioms (c, p)."""
    need = _types(t).join(axioms, "c").select(F.col("node").alias("s"), "p").distinct()
    have = t.join(axioms.select("p").distinct(), "p", "left_semi").select("s", "p", F.lit(True).alias("hit")).distinct()
    return _flagged("existential_participation", need.join(have, ["s", "p"], "left").withColumn("bad", F.col("hit").isNull()))


def property_coverage(t: DataFrame, declared: DataFrame, least: float = 1.0) -> DataFrame:
    """Declared properties (p) that no triple uses; passes with the given share of them used, a tier's minimum."""
    used = t.select("p", F.lit(True).alias("hit")).distinct()
    return _flagged("property_coverage", declared.join(used, "p", "left").withColumn("bad", F.col("hit").isNull()), 1 - least)


def value_ranges(t: DataFrame, ranges: DataFrame) -> DataFrame:
    """Numbers outside [low, high] of ranges (p, low, high), all counted. A range's p is a property's name or an end of it; the longest such end counts.

    Ranges that match no property at all are one bad row: the check then fails, though nothing was checked.
    """
    own = t.where("o_num is not null").select("s", "p", "o_num")
    rules = ranges.select(F.col("p").alias("rule"), "low", "high")
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.length("p")), lambda k: F.lower(F.substr("p", k))))
    met = own.select("p").distinct().select("p", ends.alias("end")).join(rules, F.col("end") == F.lower("rule")).groupBy("p").agg(F.max_by(F.struct("low", "high"), F.struct(F.length("rule"), "rule")).alias("of"))
    flagged = own.join(met.select("p", "of.low", "of.high"), "p").select(((F.col("o_num") < F.col("low")) | (F.col("o_num") > F.col("high"))).alias("bad"))
    return _flagged("value_ranges", flagged.unionByName(met.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(True).alias("bad"))))


def tbox_fitness(classes: DataFrame, tables: DataFrame, mapped: DataFrame, subclass: DataFrame, least: float = 0.5) -> DataFrame:
    """Classes (c), but for abstract parents (b of subclass without a source), that no table feeds; passes with the given share fed.

    A class is fed if it is mapped (c), equals a table's (name) camel-cased name, or one name holds the other in any case.
    """
    flat = tables.select(F.lower(F.translate("name", "_-.", "")).alias("flat"))  # a camel-cased name is the same in lower case
    own = classes.select("c", F.lower("c").alias("flat"))
    parts = lambda df: df.select("*", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("flat")), lambda k: F.transform(F.sequence(F.lit(1), F.length("flat") - k + 1), lambda n: F.substr("flat", k, n))))).alias("part")).drop("flat")
    alike = own.join(parts(flat).select(F.col("part").alias("flat")), "flat", "left_semi").select("c").unionByName(parts(own).join(flat.select(F.col("flat").alias("part")), "part", "left_semi").select("c"))
    fed = alike.unionByName(classes.join(mapped, "c", "left_semi").select("c")).distinct().withColumn("hit", F.lit(True))
    flagged = classes.join(fed, "c", "left").join(subclass.select(F.col("b").alias("c"), F.lit(True).alias("parent")).distinct(), "c", "left")
    return _flagged("tbox_fitness", flagged.where("hit is not null or parent is null").withColumn("bad", F.col("hit").isNull()), 1 - least)


def fk_op(fk_columns: DataFrame, object_properties: DataFrame, allowed: float = MOST_KEYS) -> DataFrame:
    """Foreign keys (domain, range) that no object property with that pair covers; self references are left out; passes with 85 % covered."""
    held = object_properties.select("domain", "range", F.lit(True).alias("hit")).distinct()
    return _flagged("fk_op", fk_columns.where("domain <> range").join(held, ["domain", "range"], "left").withColumn("bad", F.col("hit").isNull()), allowed)


def prop_completeness(t: DataFrame, expected: DataFrame, fill_rates: DataFrame | None = None, excluded: list[str] | None = None) -> DataFrame:
    """Properties (c, p, least) filled for a smaller share of the class's instances than least, or than the source's own rate (c, p, rate) where that is less.

    Excluded classes (without a source) don't count; a class without instances fills nothing, so its properties are bad.
    """
    members = _types(t).join(expected.select("c").distinct(), "c", "left_semi")
    total = members.groupBy("c").agg(F.count("*").alias("n"))
    own = t.join(expected.select("p").distinct(), "p", "left_semi").select(F.col("s").alias("node"), "p").distinct()
    filled = own.join(members, "node").groupBy("c", "p").agg(F.count("*").alias("filled"))
    due = expected.where(~F.col("c").isin(excluded or [""]))
    due = due.join(fill_rates, ["c", "p"], "left").withColumn("least", F.least("least", "rate")) if fill_rates is not None else due
    rate = F.coalesce(F.col("filled") / F.col("n"), F.lit(0.0))
    return _flagged("prop_completeness", due.join(total, "c", "left").join(filled, ["c", "p"], "left").withColumn("bad", rate < F.col("least")))


def outlier_rows(t: DataFrame) -> DataFrame:
    """(s, p, o_num, bad) of numeric properties with 3 values or more: outside 1.5 interquartile ranges, or 3 sigma where the range is 0."""
    own = t.where("o_num is not null and not isnan(o_num)").select("s", "p", "o_num")
    quartiles = qu.cumulated(own, "p", "o_num").groupBy("p").agg(qu.quantile("o_num", 0.25).alias("q1"), qu.quantile("o_num", 0.75).alias("q3"))
    spread = own.groupBy("p").agg(F.avg("o_num").alias("mean"), F.stddev_samp("o_num").alias("sd"), F.count("*").alias("n")).where("n >= 3")
    width = F.col("q3") - F.col("q1")
    beyond = (F.col("o_num") < F.col("q1") - 1.5 * width) | (F.col("o_num") > F.col("q3") + 1.5 * width)
    bad = F.when(width > 0, beyond).otherwise(F.coalesce(F.abs(F.col("o_num") - F.col("mean")) > 3 * F.col("sd"), F.lit(False)))
    return own.join(spread, "p").join(quartiles, "p").withColumn("bad", bad).select("s", "p", "o_num", "bad")


def numeric_outliers(t: DataFrame, allowed: float = FEW) -> DataFrame:
    return _flagged("numeric_outliers", outlier_rows(t), allowed)


def dangling(t: DataFrame, allowed: float = 0.0) -> DataFrame:
    """Edge targets without a type, each once; passes with at most the given share of them, a tier's minimum."""
    return _flagged("dangling", _absent(_edges(t).select("o").distinct(), "o", _types(t), "bad"), allowed)


def undeclared_op(t: DataFrame, declared: DataFrame, data_properties: DataFrame | None = None) -> DataFrame:
    """Properties with IRI values that are no declared object property (p); data properties (p) used so are another finding and are left out here."""
    used = _edges(t).select("p").distinct()
    used = used.join(data_properties.select("p"), "p", "left_anti") if data_properties is not None else used
    return _flagged("undeclared_op", used.join(declared.select("p", F.lit(True).alias("hit")).distinct(), "p", "left").withColumn("bad", F.col("hit").isNull()))


def undeclared_dp(t: DataFrame, declared: DataFrame) -> DataFrame:
    used = t.where("o_kind = 'lit'").select("p").distinct()
    return _flagged("undeclared_dp", used.join(declared.select("p", F.lit(True).alias("hit")).distinct(), "p", "left").withColumn("bad", F.col("hit").isNull()))


def string_patterns(t: DataFrame, dash_is_data: list[str] | None = None) -> DataFrame:
    """Text values that stand for a missing one, in any case; - is a value in the properties for which dash_is_data says so."""
    own = t.where("o_kind = 'lit' and o_num is null")
    exempt = (F.col("o") == "-") & F.col("p").isin(dash_is_data or [""])
    return _flagged("string_patterns", own.select((F.lower("o").isin(*INVALID_STRINGS) & ~exempt).alias("bad")))


def concentrated_values(t: DataFrame, above: float = 0.9, least: int = 5) -> DataFrame:
    """p, value, share, n: warnings of text properties with `least` values or more, one of which holds more than the given share; the least value wins ties."""
    counts = t.where("o_kind = 'lit' and o_num is null").groupBy("p", "o").agg(F.count("*").alias("k"))
    top = counts.groupBy("p").agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("less"), "o")).alias("top"))
    return top.select("p", F.col("top.o").alias("value"), (-F.col("top.less") / F.col("n")).alias("share"), "n").where((F.col("n") >= least) & (F.col("share") > above))


def functional(t: DataFrame, properties: list[str]) -> DataFrame:
    """Subjects with more than one value of a functional property."""
    return _flagged("functional", t.where(F.col("p").isin(properties)).groupBy("s", "p").agg(F.count_distinct("o").alias("n")).withColumn("bad", F.col("n") > 1))


def relationship_outliers(t: DataFrame, allowed: float = FEW) -> DataFrame:
    """(p, s) with more edges than Q3 + 1.5 IQR of the property; where that range is 0, than the upper median + 3 * 1.4826 * MAD, MAD being a true median of deviations."""
    deg = _edges(t).groupBy("p", "s").agg(F.count("*").cast("double").alias("n_edges"))
    own = qu.cumulated(deg, "p", "n_edges").groupBy("p").agg(qu.quantile("n_edges", 0.25).alias("q1"), qu.quantile("n_edges", 0.75).alias("q3"), qu.upper_median("n_edges").alias("middle"))
    dev = deg.join(own, "p").withColumn("far", F.abs(F.col("n_edges") - F.col("middle")))
    mad = qu.cumulated(dev, "p", "far").groupBy("p").agg(qu.quantile("far", 0.5).alias("mad"))
    width = F.col("q3") - F.col("q1")
    limit = F.when(width > 0, F.col("q3") + 1.5 * width).otherwise(F.col("middle") + 3 * 1.4826 * F.col("mad"))
    return _flagged("relationship_outliers", dev.join(mad, "p").withColumn("bad", F.col("n_edges") > limit), allowed)


def cardinality(t: DataFrame, limits: DataFrame, subclass: DataFrame) -> DataFrame:
    """Instances, subclasses included, whose number of values is outside [low, high] of limits (c, p, low, high); none counts as 0."""
    up = superclasses(subclass).select(F.col("a").alias("c"), F.col("b").alias("super"))
    ty = _types(t)
    closed = ty.join(up, "c").select("node", F.col("super").alias("c")).unionByName(ty).distinct()
    n = t.join(limits.select("p").distinct(), "p", "left_semi").groupBy(F.col("s").alias("node"), "p").agg(F.count_distinct("o").alias("n"))
    own = closed.join(limits, "c").join(n, ["node", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _flagged("cardinality", own.withColumn("bad", (F.col("n") < F.col("low")) | (F.col("n") > F.col("high"))))


def disjoint(t: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Instances of two members or more of a disjoint group."""
    sets = _types(t).groupBy("node").agg(F.collect_set("c").alias("cs"))  # as many as there are classes at most
    over = reduce(lambda a, b: a | b, [F.size(F.array_intersect("cs", F.array(*[F.lit(c) for c in g]))) >= 2 for g in groups], F.lit(False))
    return _flagged("disjoint", sets.withColumn("bad", over))


def master_orphan(t: DataFrame, masters: list[str], allowed: float = 0.0, pure_sources: list[str] | None = None) -> DataFrame:
    """Instances of master classes that no edge points to; classes that only point to others (pure_sources) are left out; allowed is a tier's share."""
    own = _types(t).where(F.col("c").isin([c for c in masters if c not in (pure_sources or [])]))
    return _flagged("cw_master_orphan", _absent(own, "node", _edges(t).select(F.col("o").alias("node")), "bad"), allowed)


def fk_unresolved(t: DataFrame, master: DataFrame, allowed: float = FEW) -> DataFrame:
    """Edges whose target is neither a master node nor typed; passes with at most 5 % of them."""
    return _flagged("cw_fk_unresolved", _absent(_edges(t), "o", _types(t).select("node").union(master.select("node")), "bad"), allowed)


def report(*rows: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def scored(checked: DataFrame) -> DataFrame:
    """One row: passed, total, both scores and unreliable.

    A check that doesn't apply counts as passed in the score and not at all in the measured one; one that doesn't apply and yet
    has bad rows or failed makes the score unreliable.
    """
    ok = F.count_if(F.col("passed") | ~F.col("applicable"))
    measured = F.count_if(F.col("passed") & F.col("applicable"))
    odd = F.count_if(~F.col("applicable") & ((F.col("n_bad") > 0) | ~F.col("passed"))) > 0
    share = lambda a, b: F.round(a * 100.0 / F.greatest(b, F.lit(1)), 6)
    return checked.agg(ok.alias("passed"), F.count("*").alias("total"), share(ok, F.count("*")).alias("score"), share(measured, F.count_if("applicable")).alias("measured_score"), odd.alias("unreliable"))


def run_regressions(runs: DataFrame) -> DataFrame:
    """run of scored runs (run, passed, total) worse than the one before: fewer passes, or, where the number of checks changed, more failures.

    Runs are numbered over ranges of partitions, and each meets the one before by number, so no task orders a whole history.
    """
    placed = stored(indexed(runs.select("run", "passed", "total"), ["run"], "_place"), "runs")
    earlier = placed.select((F.col("_place") + 1).alias("_place"), F.col("passed").alias("had"), F.col("total").alias("of"))
    held = placed.join(earlier, "_place")
    fewer = F.when(F.col("of") == F.col("total"), F.col("passed") < F.col("had")).otherwise(F.col("total") - F.col("passed") > F.col("of") - F.col("had"))
    return held.where(F.col("had").isNotNull() & fewer).select("run")
