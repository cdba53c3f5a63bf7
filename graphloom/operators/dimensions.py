"""Quality dimensions of a graph as scores, differences of metrics between runs, cell provenance and distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.storage import stored


def namespace(iri: Column) -> Column:
    """An IRI up to its last #, else up to its last slash; null without either."""
    upto = lambda mark: F.regexp_extract(iri, f"^(.*{mark})", 1)
    return F.when(iri.contains("#"), upto("#")).when(iri.contains("/"), upto("/"))


def amount(t: DataFrame) -> DataFrame:
    """dimension, score: 10 + 10 log10 of the number of triples, cut to an integer of 0 to 100; 0 for an empty graph."""
    n = F.count("*")
    return t.agg(F.when(n == 0, 0.0).otherwise(F.floor(F.least(F.lit(100.0), 10 + 10 * F.log10(n)))).cast("double").alias("score")).select(F.lit("amount").alias("dimension"), "score")


def trust(statements: DataFrame) -> DataFrame:
    """dimension, score of statements (confidence, source): the mean confidence, less where fewer than four sources are named; 0 without a source."""
    mean, kinds = F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3), F.count_distinct("source")
    score = F.when(kinds == 0, 0.0).otherwise(F.bround(mean * 100 * F.least(F.lit(1.0), 0.5 + kinds * 0.15), 0))
    return statements.agg(score.cast("double").alias("score")).select(F.lit("trust").alias("dimension"), "score")


def verifiability(records: DataFrame) -> DataFrame:
    """dimension, score: 20 + 30 log10 of the provenance records and one, cut to an integer of at most 100; 0 without any."""
    n = F.count("*")
    return records.agg(F.when(n == 0, 0.0).otherwise(F.floor(F.least(F.lit(100.0), 20 + 30 * F.log10(n + 1)))).cast("double").alias("score")).select(F.lit("verifiability").alias("dimension"), "score")


def representation(t: DataFrame) -> DataFrame:
    """dimension, score of triples (s, p, o, o_kind, o_dt) with full IRIs: the mean of two scores.

    Namespaces: 100 for 3 to 15 of them, 50 for fewer, 5 less for each one more. Data types: the share of literal properties with
    one type only, 100 without literals.
    """
    terms = t.select(F.explode(F.array("s", "p", F.when(F.col("o_kind") == "iri", F.col("o")))).alias("iri"))
    spaces = terms.select(namespace(F.col("iri")).alias("space")).where("space is not null").distinct().agg(F.count("*").alias("n"))
    kinds = t.where("o_kind = 'lit'").groupBy("p").agg(F.count_distinct(F.coalesce("o_dt", F.lit("plain"))).alias("kinds"))
    kinds = kinds.agg(F.count("*").alias("properties"), F.count_if(F.col("kinds") > 1).alias("mixed"))
    n = F.col("n")
    of_spaces = F.when(n < 3, 50.0).when(n <= 15, 100.0).otherwise(F.greatest(F.lit(0.0), 100.0 - (n - 15) * 5))
    of_kinds = F.when(F.col("properties") == 0, 100.0).otherwise(F.round((1 - F.col("mixed") / F.col("properties")) * 100, 1))
    # one row each
    return spaces.withColumn("k", F.lit(1)).join(kinds.withColumn("k", F.lit(1)), "k").select(F.lit("representation").alias("dimension"), F.round((of_spaces + of_kinds) / 2, 1).alias("score"))


def dimensions(*scores: DataFrame) -> DataFrame:
    """dimension, score of all given ones, and their mean as overall."""
    rows = reduce(DataFrame.unionByName, scores)
    return rows.unionByName(rows.agg(F.round(F.avg("score"), 1).alias("score")).select(F.lit("overall").alias("dimension"), "score"))


def metrics_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """metric, before, after, delta, status of two runs' metrics (metric, value): added, removed, up, down or same."""
    a, b = old.select("metric", F.col("value").alias("before")), new.select("metric", F.col("value").alias("after"))
    delta = F.col("after") - F.col("before")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(delta > 0, "up").when(delta < 0, "down").otherwise("same")
    return a.join(b, "metric", "full").select("metric", "before", "after", F.round(delta, 6).alias("delta"), status.alias("status"))


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, d): steps from each source (node) to every node that undirected edges (a, b) reach; breadth first, each round joins only what the last one added."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "both")
    fresh = stored(sources.select(F.col("node").alias("source"), "node").distinct(), "fresh")
    found, d = fresh.withColumn("d", F.lit(0)), 0
    while not fresh.isEmpty():
        d += 1
        step = fresh.join(both, F.col("node") == F.col("a")).select("source", F.col("b").alias("node")).distinct()
        fresh = stored(step.join(found, ["source", "node"], "left_anti"), "fresh")
        found = found.unionByName(fresh.withColumn("d", F.lit(d)))
    return found


def hashed_sample(edges: DataFrame, n: int) -> DataFrame:
    """The n nodes of edges (a, b) with the least digests, so that reruns agree."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return nodes.orderBy(F.md5("node"), "node").limit(n)


def approximate_diameter(edges: DataFrame, n_sources: int = 50) -> DataFrame:
    """One row: sampled_sources, approx_diameter and median_eccentricity over a sample of n_sources nodes, chosen by hash; 0 for a graph without edges."""
    each = distances(edges, hashed_sample(edges, n_sources)).groupBy("source").agg(F.max("d").alias("d"))
    ranked = F.sort_array(F.collect_list("d"))  # n_sources values at most
    middle = F.get(ranked, F.floor(F.size(ranked) / 2).cast("int"))
    return each.agg(F.count("*").alias("sampled_sources"), F.coalesce(F.max("d"), F.lit(0)).alias("approx_diameter"), F.coalesce(middle, F.lit(0)).alias("median_eccentricity"))


def cell_provenance(df: DataFrame, name: str, instance: Column, row: str, cells: dict[str, str]) -> DataFrame:
    """Triples (s, p, o) that lead from instances to a table's row (its number in column row) and to the cells behind properties (property: column).

    An instance has one edge to its row, a row three triples, a cell six; one scan of the table. A null cell has them too, as its place is what they state.
    """
    own = F.concat(F.lit(f"prov://{name}#row="), F.col(row).cast("string"))
    triple = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    place = lambda s: [triple(s, "type", F.lit("Entity")), triple(s, "csvTable", F.lit(name)), triple(s, "rowNumber", F.col(row).cast("string"))]
    made = [triple(instance, "wasDerivedFrom", own), *place(own)]
    for p, column in cells.items():
        cell = F.concat(own, F.lit(f"&col={column}"))
        made += [*place(cell), triple(cell, "column", F.lit(column)), triple(cell, "property", F.lit(p)), triple(cell, "wasDerivedFrom", own)]
    return df.select(F.explode(F.array(*made)).alias("t")).select("t.*")


def traced_cells(provenance: DataFrame) -> DataFrame:
    """instance, source_table, row_number, property, column of the cells that instances come from by the triples of cell_provenance."""
    derived = provenance.where("p = 'wasDerivedFrom'").select("s", F.col("o").alias("row"))
    is_cell = F.col("s").startswith("prov://") & F.col("s").contains("&col=")
    of_cell = provenance.where(F.col("p").isin("csvTable", "rowNumber", "property", "column") & is_cell)
    told = of_cell.groupBy("s").pivot("p", ["csvTable", "rowNumber", "property", "column"]).agg(F.max("o"))
    cells = derived.where(is_cell).join(told, "s").drop("s")
    instances = derived.where(~F.col("s").startswith("prov://")).select(F.col("s").alias("instance"), "row")
    return instances.join(cells, "row").select("instance", F.col("csvTable").alias("source_table"), F.col("rowNumber").cast("long").alias("row_number"), "property", "column")


def understandability(terms: DataFrame, labels: DataFrame, comments: DataFrame) -> DataFrame:
    """One row: label_pct, comment_pct, bilingual_pct of terms (term) and score, which weighs them 0.4, 0.3 and 0.3; 0 without terms.

    labels (term, lang), comments (term). A term is bilingual with an English label and one in another language.
    """
    english, other = F.col("lang") == "en", F.col("lang") != "en"
    own = labels.groupBy("term").agg(F.lit(True).alias("labelled"), (F.coalesce(F.bool_or(english), F.lit(False)) & F.coalesce(F.bool_or(other), F.lit(False))).alias("bilingual"))
    each = terms.select("term").distinct().join(own, "term", "left").join(comments.select("term", F.lit(True).alias("told")).distinct(), "term", "left")
    pct = lambda c: F.when(F.count("*") > 0, F.count_if(c) * 100.0 / F.count("*")).otherwise(0.0)
    parts = each.agg(pct("labelled").alias("label_pct"), pct("told").alias("comment_pct"), pct("bilingual").alias("bilingual_pct"))
    return parts.withColumn("score", F.round(F.col("label_pct") * 0.4 + F.col("comment_pct") * 0.3 + F.col("bilingual_pct") * 0.3, 6)).select(*[F.round(c, 6).alias(c) for c in ("label_pct", "comment_pct", "bilingual_pct")], "score")
