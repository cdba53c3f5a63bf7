"""Dictionary statistics, drift, round trip, topology, provenance, confidence, property graph and run history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.coercion import jaccard, trigrams
from graphloom.operators import quantiles as qu
from graphloom.operators.reasoning import superclasses
from graphloom.sources.tables import ntriples_lines

#: Confidence by source of a statement.
CONFIDENCE = {"csv": 1.0, "fk_verified": 0.95, "rl": 0.85}


def numeric_stats(t: DataFrame) -> DataFrame:
    """p, n, low, high, mean, p10, p50, p90 of numeric properties, the last four to six places (sums of doubles depend on their order)."""
    own = t.where("o_num is not null and not isnan(o_num)")
    plain = own.groupBy("p").agg(F.count("*").alias("n"), F.min("o_num").alias("low"), F.max("o_num").alias("high"), F.round(F.avg("o_num"), 6).alias("mean"))
    q = qu.cumulated(own, "p", "o_num").groupBy("p").agg(*[F.round(qu.quantile("o_num", d / 100), 6).alias(f"p{d}") for d in (10, 50, 90)])
    return plain.join(q, "p")


def distinct_values(t: DataFrame, most: int = 20, sample: int = 5) -> DataFrame:
    """p, n_distinct, listed: all values of a text property with at most `most`, else the first ones."""
    own = t.where("o_kind = 'lit' and o_num is null").select("p", "o").distinct()
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("p").orderBy("o"))).where(F.col("rank") <= most)
    n = own.groupBy("p").agg(F.count("*").alias("n_distinct"))
    kept = ranked.join(n, "p").where((F.col("n_distinct") <= most) | (F.col("rank") <= sample))
    return kept.groupBy("p", "n_distinct").agg(F.array_join(F.sort_array(F.collect_list("o")), "|").alias("listed"))


def unit_mismatch(t: DataFrame, skip: list[str] | None = None, least: int = 5, ratio: float = 50.0) -> DataFrame:
    """p, low, high of properties with `least` positive values whose largest is ratio times the smallest or more."""
    own = t.where("o_num > 0").where(~F.col("p").isin(skip or [""]))
    return own.groupBy("p").agg(F.count("*").alias("n"), F.min("o_num").alias("low"), F.max("o_num").alias("high")).where((F.col("n") >= least) & (F.col("high") >= F.col("low") * ratio)).select("p", "low", "high")


def two_hop_paths(schema: DataFrame, most: int = 10) -> DataFrame:
    """source, via, target, score, rank of two-hop class paths (domain, p, range), the best of each source."""
    a = schema.select(F.col("domain").alias("source"), F.col("range").alias("via"), F.col("n").alias("n1"))
    b = schema.select(F.col("domain").alias("via"), F.col("range").alias("target"), F.col("n").alias("n2"))
    paths = a.join(b, "via").where("source <> target").groupBy("source", "via", "target").agg(F.sum(F.least("n1", "n2")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "target", "via"))
    return paths.withColumn("rank", rank).where(F.col("rank") <= most)


def class_links(t: DataFrame) -> DataFrame:
    """domain, p, range, n of edges between typed nodes."""
    ty = t.where("p = 'type'").select(F.col("s").alias("node"), F.col("o").alias("c"))
    e = t.where("o_kind = 'iri' and p <> 'type'").select("s", "p", "o")
    own = e.join(ty.select(F.col("node").alias("s"), F.col("c").alias("domain")), "s").join(ty.select(F.col("node").alias("o"), F.col("c").alias("range")), "o")
    return own.groupBy("domain", "p", "range").agg(F.count("*").alias("n"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """change, value of distinct values (value) added or removed, no cap."""
    a, b = old.select("value").distinct(), new.select("value").distinct()
    return b.join(a, "value", "left_anti").select(F.lit("added").alias("change"), "value").unionByName(a.join(b, "value", "left_anti").select(F.lit("removed").alias("change"), "value"))


def emerging(old: DataFrame, new: DataFrame, most: int = 20, below: float = 0.3) -> DataFrame:
    """value, similarity: of the first added values those whose best 3-gram similarity to an old value is below the bound.

    Only old values that share a gram can have one above 0, so the join is on grams.
    """
    added = new.select("value").distinct().join(old.select("value").distinct(), "value", "left_anti").orderBy("value").limit(most).withColumn("grams", trigrams(F.col("value")))
    known = old.select(F.col("value").alias("old")).distinct().withColumn("old_grams", trigrams(F.col("old")))
    met = added.withColumn("g", F.explode("grams")).join(known.withColumn("g", F.explode("old_grams")), "g").select("value", "grams", "old", "old_grams").distinct()
    best = met.groupBy("value").agg(F.max(jaccard(F.col("grams"), F.col("old_grams"))).alias("similarity"))
    return added.select("value").join(best, "value", "left").select("value", F.coalesce("similarity", F.lit(0.0)).alias("similarity")).where(F.col("similarity") < below)


def roundtrip(source: DataFrame, rebuilt: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row of a table rebuilt from the graph: row_recall and cell_recall in percent of the source, and n_extra rows that it lacks."""
    a = source.select(key, F.lit(True).alias("there"), *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    b = rebuilt.select(key, F.lit(True).alias("hit"), *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    j = a.join(b, key, "full")
    cells = sum((F.count_if(F.col(f"a_{c}").isNotNull()) for c in columns), F.lit(0))
    right = sum((F.count_if(F.col(f"a_{c}") == F.col(f"b_{c}")) for c in columns), F.lit(0))
    rows = F.count_if("there")
    pct = lambda x, of: x * 100.0 / F.greatest(of, F.lit(1))
    return j.agg(pct(F.count_if(F.col("there") & F.col("hit")), rows).alias("row_recall"), pct(right, cells).alias("cell_recall"), F.count_if(F.col("there").isNull()).alias("n_extra"))


def pivoted(t: DataFrame, c: str, properties: list[str], order: str | None = None) -> DataFrame:
    """One row for each instance of a class: node and the last value of each property by a column of t that says their order; without one, the greatest."""
    members = t.where((F.col("p") == "type") & (F.col("o") == c)).select("s")
    own = t.where(F.col("p").isin(properties)).join(members, "s", "left_semi")
    last = F.max("o") if order is None else F.max_by("o", F.struct(order, "o"))
    return own.groupBy(F.col("s").alias("node")).pivot("p", properties).agg(last)


def degrees(t: DataFrame) -> DataFrame:
    """node, degree on the simple directed graph (parallel edges collapse, loops count twice)."""
    e = t.where("o_kind = 'iri' and p <> 'type'").select("s", "o").distinct()
    return e.select(F.col("s").alias("node")).union(e.select("o")).groupBy("node").agg(F.count("*").alias("degree"))


def degree_stats(deg: DataFrame) -> DataFrame:
    """One row: n, mean and the values at index int(n * q / 100) of the sorted degrees. Degrees are few, so their counts are cumulated."""
    counts = deg.groupBy("degree").agg(F.count("*").alias("n"))
    cumulated = counts.withColumn("until", F.sum("n").over(Window.orderBy("degree"))).crossJoin(counts.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("degree")).alias("sum")))
    at = lambda q: F.min(F.when(F.col("until") > F.least(F.floor(F.col("total") * q / 100), F.col("total") - 1), F.col("degree")))
    return cumulated.agg(F.max("total").alias("n"), (F.max("sum") / F.max("total")).alias("mean"), at(50).alias("p50"), at(90).alias("p90"), at(99).alias("p99"), F.max("degree").alias("highest"))


def statement_id(*columns: str):
    return F.concat(F.lit("stmt_"), F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 16))


def confidence_summary(t: DataFrame, source) -> DataFrame:
    """source, n, confidence of statements by where they come from."""
    table = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return t.withColumn("source", source).groupBy("source").agg(F.count("*").alias("n")).withColumn("confidence", F.coalesce(F.try_element_at(table, "source"), F.lit(0.3)))


def chained_confidence(depth):
    """1 / depth, 0.3 at least."""
    return F.greatest(F.lit(1.0) / F.greatest(depth, F.lit(1)), F.lit(0.3))


def row_provenance(df: DataFrame, name: str, key: str, prefix: str) -> DataFrame:
    """instance, source_table, source_key of the row that an instance comes from."""
    return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("instance"), F.lit(name).alias("source_table"), F.col(key).cast("string").alias("source_key"))


def most_specific(types: DataFrame, subclass: DataFrame) -> DataFrame:
    """uri, label of types (uri, label) without those that are above another label of the same node; a node whose labels are all above each other keeps them."""
    above = superclasses(subclass).select(F.col("a").alias("label"), F.col("b").alias("higher"))
    higher = types.join(above, "label").select("uri", F.col("higher").alias("label")).distinct()
    lowest = types.join(higher, ["uri", "label"], "left_anti")
    return lowest.unionByName(types.join(lowest.select("uri"), "uri", "left_anti"))


def lpg_nodes(t: DataFrame, subclass: DataFrame | None = None) -> DataFrame:
    """uri, labels, props: labels in order, only the most specific ones if subclass pairs are given; multi-valued properties as arrays in one map."""
    types = t.where("p = 'type'").select(F.col("s").alias("uri"), F.col("o").alias("label")).distinct()
    labels = (types if subclass is None else most_specific(types, subclass)).groupBy("uri").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    lists = t.where("o_kind = 'lit'").groupBy(F.col("s").alias("uri"), "p").agg(F.sort_array(F.collect_set("o")).alias("v"))
    props = lists.groupBy("uri").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("p", "v")))).alias("props"))
    return labels.join(props, "uri", "full")


def lpg_rels(t: DataFrame, inverse: DataFrame, canonical: list[str] | None = None) -> DataFrame:
    """start, end, type of edges: loops go, and of an inverse pair (p, q), declared one way or both, one property's direction stays.

    It is the lesser name's, or that of a property named in canonical. A property that is its own inverse keeps its edges; one with several
    inverses is turned into the least that stays.
    """
    e = t.where("o_kind = 'iri' and p <> 'type' and s <> o").select("s", "p", "o")
    low, high, wanted = F.least("p", "q"), F.greatest("p", "q"), canonical or []
    turned = high.isin(wanted) & ~low.isin(wanted)
    pairs = inverse.where("p <> q").select(F.when(turned, low).otherwise(high).alias("p"), F.when(turned, high).otherwise(low).alias("to"))
    flip = pairs.groupBy("p").agg(F.min("to").alias("to"))
    own = e.join(flip, "p", "left")
    return own.select(F.when(F.col("to").isNull(), F.col("s")).otherwise(F.col("o")).alias("start"), F.when(F.col("to").isNull(), F.col("o")).otherwise(F.col("s")).alias("end"), F.coalesce("to", "p").alias("type")).distinct()


def sparse_properties(t: DataFrame, below: float = 0.01) -> DataFrame:
    """c, p, share of properties that fewer than the given share of a class's instances have."""
    ty = t.where("p = 'type'").select("s", F.col("o").alias("c"))
    total = ty.groupBy("c").agg(F.count("*").alias("n"))
    have = t.where("o_kind = 'lit'").select("s", "p").distinct().join(ty, "s").groupBy("c", "p").agg(F.count("*").alias("k"))
    return have.join(total, "c").select("c", "p", (F.col("k") / F.col("n")).alias("share")).where(F.col("share") < below)


def graph_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, s, p, o of triples that only one graph has."""
    key = ["s", "p", "o"]
    return a.select(*key).join(b.select(*key), key, "left_anti").select(F.lit("left").alias("side"), *key).unionByName(b.select(*key).join(a.select(*key), key, "left_anti").select(F.lit("right").alias("side"), *key))


def graph_hash(t: DataFrame) -> DataFrame:
    """One row: n and a digest of the graph, whatever its order: SHA-256 over the sorted SHA-256 of its N-Triples lines, by chunks.

    Lines tell IRIs, literals, data types and languages apart, whatever characters terms hold. They are dealt to 16**6 chunks by the start of
    their hash, chunks to 16**3 groups, and each level hashes its sorted parts, so no task sorts the whole graph. Blank nodes count by
    their labels; blank.canonical gives labels that do not depend on the given ones.
    """
    level = lambda df, keep, parts: df.groupBy(F.substring(parts, 1, keep).alias("at")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(parts)), ""), 256).alias("h"), F.sum("n").alias("n"))
    # hashes go as bytes and once, by chunk: repeated lines meet in theirs
    own = ntriples_lines(t).select(F.sha2("value", 256).alias("h")).select(F.substring("h", 1, 6).alias("at"), F.unhex("h").alias("h")).repartition("at").distinct()
    text = F.array_join(F.transform(F.sort_array(F.collect_list("h")), lambda x: F.lower(F.hex(x))), "")
    chunks = own.groupBy("at").agg(F.sha2(text, 256).alias("h"), F.count("*").alias("n")).select(F.concat("at", "h").alias("h"), "n")
    groups = level(chunks, 3, "h").select(F.concat("at", "h").alias("h"), "n")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("digest"))


def failure_patterns(events: DataFrame, kind: str, now: str, hours: int, least: int) -> DataFrame:
    """user_id, n of a kind of event in the hours before now, at least so many."""
    own = events.where((F.col("event_type") == kind) & (F.col("ts") >= F.expr(f"timestamp_ntz'{now}' - interval {hours} hours")))
    return own.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def regressions(runs: DataFrame, case: str, order: str, status: str) -> DataFrame:
    """case, order of runs that fail where the run before passed."""
    before = F.lag(status).over(Window.partitionBy(case).orderBy(order))
    return runs.withColumn("before", before).where((F.col("before") == "pass") & (F.col(status) == "fail")).select(case, order)


def cooccurrence(failures: DataFrame, least: int = 5, share: float = 0.9) -> DataFrame:
    """a, b, both, share of checks (run, check) that fail together: in share of a's failing runs or more, of at least so many."""
    own = failures.select("run", "check").distinct()
    n = own.groupBy(F.col("check").alias("a")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    met = own.select("run", F.col("check").alias("a")).join(own.select("run", F.col("check").alias("b")), "run").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("both"))
    return met.join(n, "a").select("a", "b", "both", (F.col("both") / F.col("n")).alias("share")).where(F.col("share") >= share)


def instance_quality(t: DataFrame, declared: DataFrame, links: list[str], sources: DataFrame, datatypes: DataFrame) -> DataFrame:
    """metric, value (percent) of the five measures and their mean as overall, each to one place.

    population: instances of the rows of their source (sources: c, rows), a mean over classes; completeness and richness: the share of
    a class's declared properties (declared: p, c) that its instances have, and how many they have against those declared (100 at most), means over classes;
    interlinking: instances with one of the link properties; datatypes: literals whose o_dt is the declared one (datatypes: p, dt). 0 where there is nothing.
    """
    ty = t.where("p = 'type'").select("s", F.col("o").alias("c")).join(declared.select("c").distinct(), "c", "left_semi")
    n_declared = declared.groupBy("c").agg(F.count_distinct("p").alias("declared"))
    total = ty.groupBy("c").agg(F.count("*").alias("instances")).join(n_declared, "c")
    own = t.select("s", "p").where("p <> 'type'").distinct().join(ty, "s")
    held = own.join(declared.select("p", "c", F.lit(1).alias("due")).distinct(), ["p", "c"], "left").groupBy("c").agg(F.count("due").alias("filled"), F.count("*").alias("actual"))
    share = lambda c: F.coalesce(c, F.lit(0)) / (F.col("instances") * F.col("declared")) * 100
    per_class = total.join(held, "c", "left").select(share(F.col("filled")).alias("completeness"), share(F.col("actual")).alias("richness"))
    linked = t.where(F.col("p").isin(links)).select("s", F.lit(1).alias("hit")).distinct()
    population = sources.where("rows > 0").join(ty.groupBy("c").agg(F.count("*").alias("k")), "c", "left").select((F.coalesce("k", F.lit(0)) / F.col("rows") * 100).alias("v"))
    told = t.where("o_kind = 'lit'").join(datatypes, "p").select(F.coalesce(F.col("o_dt") == F.col("dt"), F.lit(False)).alias("hit"))
    one = lambda df, metric, value: df.agg(F.round(F.coalesce(value, F.lit(0.0)), 1).alias("value")).select(F.lit(metric).alias("metric"), "value")
    rows = [
        one(population, "population", F.avg("v")), one(per_class, "completeness", F.avg("completeness")), one(per_class, "richness", F.least(F.avg("richness"), F.lit(100.0))),
        one(ty.join(linked, "s", "left"), "interlinking", F.count("hit") * 100.0 / F.greatest(F.count("*"), F.lit(1))),
        one(told, "datatypes", F.count_if("hit") * 100.0 / F.greatest(F.count("*"), F.lit(1))),
    ]
    each = reduce(DataFrame.unionByName, rows)
    return each.unionByName(one(each, "overall", F.avg("value")))


def timeliness(age_days, stale=None):
    """100 up to 30 days, falling to 0 at 180; 20 less if stale."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) * (180 - age_days) / 150))
    return F.greatest(F.lit(0.0), base - F.when(stale, 20).otherwise(0)) if stale is not None else base


def amount_score(n):
    """10 + 10 log10(n), between 0 and 100."""
    return F.least(F.lit(100.0), F.when(n > 0, 10 + 10 * F.log10(n)).otherwise(0.0))
