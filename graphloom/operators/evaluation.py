"""Questions to a graph and their history: links between classes, competency questions, golden cases, entailments, alerts, causal chains, parity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.analytics import class_links
from graphloom.sources.tables import inline
from graphloom.storage import stored


def class_paths(links: DataFrame, pairs: DataFrame, most: int = 3) -> DataFrame:
    """source, target, hops: the least number of links (domain, range; either way), at most `most`, between pairs of classes; without a path no row.

    Breadth first over the class graph, each round from what the last one reached.
    """
    either = links.select(F.col("domain").alias("a"), F.col("range").alias("b")).union(links.select("range", "domain")).where("a <> b").distinct()
    found = fresh = pairs.select("source", F.col("source").alias("node")).distinct().withColumn("hops", F.lit(0))
    for hops in range(1, most + 1):
        step = fresh.join(either, F.col("node") == F.col("a")).select("source", F.col("b").alias("node")).distinct().join(found, ["source", "node"], "left_anti")
        fresh = stored(step.withColumn("hops", F.lit(hops)), "paths")
        found = found.unionByName(fresh)
    return pairs.join(found.withColumnRenamed("node", "target"), ["source", "target"])


def linked_classes(t: DataFrame, pairs: DataFrame) -> DataFrame:
    """source, target, stage of pairs of classes by how their instances are linked: 1 forward, 2 reverse, 3 through one node between, null if not.

    Classes meet through counts of links and through the classes next to each node, never as products of their instances; types are no links.
    """
    direct = class_links(t).select("domain", "range").distinct()
    ty = t.where("p = 'type'").select(F.col("s").alias("node"), F.col("o").alias("c")).distinct()
    e = t.where("o_kind = 'iri' and p <> 'type'").select("s", "o").distinct()
    near = e.select(F.col("s").alias("m"), F.col("o").alias("node")).union(e.select("o", "s")).join(ty, "node").select("m", "c").distinct()
    asked = near.join(pairs.select(F.col("source").alias("c")).union(pairs.select("target")).distinct(), "c", "left_semi")
    across = asked.join(asked.select("m", F.col("c").alias("d")), "m").select("c", "d").distinct()
    stages = [
        direct.select(F.col("domain").alias("source"), F.col("range").alias("target"), F.lit(1).alias("stage")),
        direct.select(F.col("range").alias("source"), F.col("domain").alias("target"), F.lit(2).alias("stage")),
        across.select(F.col("c").alias("source"), F.col("d").alias("target"), F.lit(3).alias("stage")),
    ]
    best = reduce(DataFrame.unionByName, stages).groupBy("source", "target").agg(F.min("stage").alias("stage"))
    return pairs.select("source", "target").distinct().join(best, ["source", "target"], "left")


def competency_coverage(questions: DataFrame, schema_links: DataFrame, graph: DataFrame, inferred: DataFrame, most: int = 3) -> DataFrame:
    """q, in_schema, in_graph, in_inferred of questions (q, source, target): whether classes are linked in the schema (domain, range), and instances in either graph."""
    pairs = questions.select("source", "target").distinct()
    of_schema = class_paths(schema_links, pairs, most).select("source", "target", F.lit(True).alias("in_schema"))
    linked = lambda t, name: linked_classes(t, pairs).where("stage is not null").select("source", "target", F.lit(True).alias(name))
    out = questions
    for df in (of_schema, linked(graph, "in_graph"), linked(inferred, "in_inferred")):
        out = out.join(df, ["source", "target"], "left")
    return out.select("q", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_schema", "in_graph", "in_inferred")])


def shortest_class_paths(links: DataFrame, pairs: DataFrame, most: int = 3) -> DataFrame:
    """source, target, hops, path of pairs of classes: every path of least length up to `most` over links (domain, p, range), either way.

    path is an array of steps (p, forward, c), c being the class that a step reaches. Each round goes on from what the last one reached, and enters
    no class that was reached in fewer steps; the predecessors are the paths themselves.
    """
    own = links.select("domain", "p", "range").distinct()
    ways = own.select(F.col("domain").alias("a"), F.struct("p", F.lit(True).alias("forward"), F.col("range").alias("c")).alias("step"))
    ways = ways.union(own.select(F.col("range").alias("a"), F.struct("p", F.lit(False).alias("forward"), F.col("domain").alias("c")).alias("step")))
    wanted = pairs.select("source", "target").where("source <> target").distinct()
    start = F.array().cast("array<struct<p:string,forward:boolean,c:string>>")
    fresh = wanted.select("source", F.col("source").alias("node"), start.alias("path")).distinct()
    seen, found = fresh.select("source", "node"), []
    for hops in range(1, most + 1):
        on = fresh.join(ways, F.col("node") == F.col("a")).select("source", F.col("step.c").alias("node"), F.concat("path", F.array("step")).alias("path"))
        fresh = stored(on.join(seen, ["source", "node"], "left_anti"), "class-paths")
        seen = seen.union(fresh.select("source", "node").distinct())
        found.append(fresh.select("source", F.col("node").alias("target"), F.lit(hops).alias("hops"), "path"))
    return wanted.join(reduce(DataFrame.unionByName, found), ["source", "target"])


def connectivity(t: DataFrame, links: DataFrame, pairs: DataFrame, most: int = 3) -> DataFrame:
    """source, target, path, hops, n_start, reached, phase of each shortest path between pairs of classes, and of pairs without one: the queries that test a link, run.

    A path's query starts with the instances of its source and goes step by step along its property to instances of the step's class; reached
    lists how many different ones each step finds. phase is where it ends: no_path, no_instances, step k without a result, or connected.
    All queries run together: a step is one join of what the last one reached, told apart by path, with the edges, never of instances with instances.
    """
    paths = shortest_class_paths(links, pairs, most)
    step_text = F.transform("path", lambda x: F.concat(F.when(x["forward"], F.lit(" -")).otherwise(" <"), x["p"], F.when(x["forward"], F.lit("> ")).otherwise("- "), x["c"]))
    named = stored(paths.withColumn("text", F.concat("source", F.array_join(step_text, ""))), "paths")
    ty = t.where("p = 'type'").select(F.col("s").alias("node"), F.col("o").alias("c")).distinct()
    e = t.where("o_kind = 'iri' and p <> 'type'").select("s", "p", "o").distinct()
    ways = e.select(F.col("s").alias("node"), "p", F.lit(True).alias("forward"), F.col("o").alias("to")).union(e.select("o", "p", F.lit(False), "s"))
    at = stored(named.select("text", F.col("source").alias("c")).join(ty, "c").select("text", "node"), "reached")
    counts = []
    for k in range(most):
        steps = named.where(F.size("path") > k).select("text", F.col("path")[k].alias("step")).select("text", "step.*")
        on = at.join(steps.withColumnRenamed("c", "want"), "text").join(ways, ["node", "p", "forward"]).select("text", F.col("to").alias("node"), F.col("want").alias("c")).distinct()
        at = stored(on.join(ty, ["node", "c"], "left_semi").select("text", "node"), "reached")
        counts.append(at.groupBy("text").agg(F.count("*").alias("n")).withColumn("k", F.lit(k)))
    by_step = reduce(DataFrame.unionByName, counts).groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("n_by_step"))
    starts = ty.groupBy(F.col("c").alias("source")).agg(F.count("*").alias("n_start"))
    of_step = lambda k: F.coalesce(F.try_element_at("n_by_step", k), F.lit(0))
    told = pairs.select("source", "target").where("source <> target").distinct().join(named, ["source", "target"], "left").join(starts, "source", "left").join(by_step, "text", "left")
    reached = F.transform(F.sequence(F.lit(0), F.col("hops") - 1), of_step)
    failed = F.array_position(F.col("reached"), F.lit(0).cast("long"))
    phase = F.when(F.col("text").isNull(), "no_path").when(F.coalesce("n_start", F.lit(0)) == 0, "no_instances").when(failed > 0, F.concat(F.lit("step "), failed.cast("string"))).otherwise("connected")
    out = told.withColumns({"n_start": F.coalesce("n_start", F.lit(0)), "reached": F.when(F.col("hops").isNotNull(), reached)})
    return out.select("source", "target", F.col("text").alias("path"), "hops", "n_start", "reached", phase.alias("phase"))


def link_pattern(source: str, links: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Triple patterns (s, p, o) that lead from instances of a class along links (domain, p, range), either way: what graph.match and graph.join take."""
    patterns, at, known = [("?x0", "type", source)], source, 0
    for domain, p, range_ in links:
        forward = domain == at
        at = range_ if forward else domain
        ends = (f"?x{known}", f"?x{known + 1}")
        patterns += [(ends[0], p, ends[1]) if forward else (ends[1], p, ends[0]), (ends[1], "type", at)]
        known += 1
    return patterns


def golden_case(case: str, df: DataFrame, min_rows: int = 0, max_rows: int | None = None, required: list[str] | None = None, tokens: list[str] | None = None, banned: list[str] | None = None, text: str = "") -> DataFrame:
    """One row: case, n_rows, status (pass or fail) and failures of a query's result against bounds, required variables, and tokens that the query's text must hold or lack."""
    n = F.col("n_rows")
    missing = [v for v in required or [] if v not in df.columns]
    lacks, holds = [x for x in tokens or [] if x not in text], [x for x in banned or [] if x in text]
    tests = [("min_rows", n < min_rows), ("max_rows", n > max_rows if max_rows is not None else F.lit(False)), ("required", (n > 0) & F.lit(bool(missing))), ("tokens", F.lit(bool(lacks))), ("banned", F.lit(bool(holds)))]
    failures = F.array_join(F.array_compact(F.array(*[F.when(bad, name) for name, bad in tests])), ",")
    counted = df.agg(F.count("*").alias("n_rows")).withColumn("failures", failures)
    return counted.select(F.lit(case).alias("case"), "n_rows", F.when(F.col("failures") == "", "pass").otherwise("fail").alias("status"), "failures")


def entailment_cases(t: DataFrame, cases: DataFrame) -> DataFrame:
    """case, holds, passed of cases (case, s, p, o, expected): whether the graph has the triple, and whether that is as expected."""
    known = t.select("s", "p", "o", F.lit(True).alias("hit")).distinct()
    holds = F.coalesce("hit", F.lit(False))
    return cases.join(known, ["s", "p", "o"], "left").select("case", holds.alias("holds"), (holds == F.col("expected")).alias("passed"))


def failure_alerts(holders: DataFrame, patterns: DataFrame, tags: DataFrame, alarms: DataFrame, now: str, default_hours: int = 720) -> DataFrame:
    """equipment, pattern, failure, threshold, n_alarms, alert of all holders (equipment, pattern) whose pattern is known.

    patterns (pattern, threshold, hours, failure), tags (equipment, tag), alarms (alarm, tag, ts). An alarm counts through every tag that it shares with the equipment. Where
    the pattern's hours are null or default_hours at least, all its alarms count; else those in the hours before now and those without a
    time. Equipment without alarms counts 0, which reaches a threshold of 0. alert tells whether the threshold is reached.

    No alarm is compared with a window: alarms are counted by tag and hours of age, rounded up, which a window of whole hours parts
    exactly. Ages beyond default_hours are one, so a tag has at most that many counts, which then meet its equipment.
    """
    windowed = patterns.withColumn("hours", F.when(F.col("hours") < default_hours, F.col("hours")).cast("int"))
    micros = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    age = F.when(F.col("ts").isNull() | (micros < 0), F.lit(0)).otherwise(F.least(F.ceil(micros / F.lit(3_600_000_000)), F.lit(default_hours)))
    of_tag = alarms.groupBy("tag", age.cast("long").alias("age")).agg(F.count("*").alias("n"))
    own = holders.distinct().join(windowed, "pattern")
    counted = own.join(tags.distinct(), "equipment").join(of_tag, "tag").where(F.col("hours").isNull() | (F.col("age") <= F.col("hours")))
    found = counted.groupBy("equipment", "pattern").agg(F.sum("n").alias("n"))
    n = F.coalesce("n", F.lit(0)).alias("n_alarms")
    return own.join(found, ["equipment", "pattern"], "left").select("equipment", "pattern", "failure", "threshold", n, (F.coalesce("n", F.lit(0)) >= F.coalesce("threshold", F.lit(0))).alias("alert"))


def unassigned_patterns(patterns: DataFrame, holders: DataFrame) -> DataFrame:
    """Patterns that no equipment holds."""
    return patterns.join(holders, "pattern", "left_anti")


def causal_chains(rules: DataFrame, start: str, direction: str = "change") -> DataFrame:
    """path, cyclic of chains of rules (cause, effect, effect_dir) from a parameter: cause(direction)>effect(direction) and so on.

    Breadth first; each parameter is entered once, on its shortest path (the least of equal ones), and each of its rules adds one chain, so there are
    as many chains as rules within reach. A chain is cyclic if it comes back to a parameter on its own path.
    """
    spark = rules.sparkSession
    own = rules.select("cause", "effect", F.coalesce("effect_dir", F.lit("")).alias("effect_dir") if "effect_dir" in rules.columns else F.lit("").alias("effect_dir")).distinct()
    label = lambda name, way: F.when(way == "", name).otherwise(F.concat(name, F.lit("("), way, F.lit(")")))
    fresh = inline(spark, [(start, direction, [start], start if direction == "" else f"{start}({direction})")], "at string, dir string, seen array<string>, path string")
    seen, chains = fresh.select("at"), []
    while True:
        on = fresh.join(own, F.col("at") == F.col("cause"))
        path = F.concat("path", F.lit(">"), label(F.col("effect"), F.col("effect_dir")))
        made = stored(on.select("effect", "effect_dir", "seen", path.alias("path"), F.array_contains("seen", F.col("effect")).alias("cyclic")), "chains")
        chains.append(made.select("path", "cyclic"))
        to = made.where("not cyclic").join(seen.withColumnRenamed("at", "effect"), "effect", "left_anti")
        first = to.groupBy("effect").agg(F.min(F.struct("path", "effect_dir", "seen")).alias("x"))
        fresh = stored(first.select(F.col("effect").alias("at"), F.col("x.effect_dir").alias("dir"), F.concat("x.seen", F.array("effect")).alias("seen"), "x.path"), "entered")
        if fresh.isEmpty():
            return reduce(DataFrame.unionByName, chains)
        seen = seen.union(fresh.select("at"))


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, a, b, differs_pct, status of scalar counts (metric, value) from two stores: identical, near_identical up to 5 % of the greater, divergent, or insufficient with one only."""
    both = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full")
    pct = F.round(F.abs(F.col("a") - F.col("b")) * 100.0 / F.greatest("a", "b", F.lit(1)), 2)
    status = F.when(F.col("a").isNull() | F.col("b").isNull(), "insufficient").when(pct == 0, "identical").when(pct <= 5, "near_identical").otherwise("divergent")
    return both.select("metric", "a", "b", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), pct).alias("differs_pct"), status.alias("status"))
