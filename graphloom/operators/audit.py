"""Audits: antipatterns of a schema, inverses that fit, links to other vocabularies, restrictions against shapes, what checks never catch, betweenness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.dimensions import distances
from graphloom.operators.graph import transitive
from graphloom.operators.reasoning import inverse_complete, superclasses
from graphloom.storage import discard, stored

THING = "Thing"


def antipatterns(classes: DataFrame, properties: DataFrame, subclass: DataFrame, inverse: DataFrame, groups: DataFrame) -> DataFrame:
    """rule and subject: lazy_class, lonely_disjoint, asymmetric_inverse, redundant_subclass.

    classes (c), properties (p, domain, range), subclass (a, b), inverse (p, q), groups (g, c; of disjoint classes, a null class for an empty group). A class is
    lazy if no property names it; a group is lonely with one class at most; a declared inverse is asymmetric without its opposite; a subclass pair is
    redundant if another direct superclass leads to the same class.
    """
    found = lambda rule, df, subject: df.select(F.lit(rule).alias("rule"), subject.alias("subject"))
    pair = lambda a, b: F.concat_ws(" ", a, b)
    used = properties.select(F.explode(F.array("domain", "range")).alias("c"))
    direct = subclass.where("a <> b").select("a", "b").distinct()
    by_other = direct.select("a", F.col("b").alias("m")).join(transitive(direct).select(F.col("a").alias("m"), "b"), "m").where("m <> b").select("a", "b")
    rows = [
        found("lazy_class", classes.join(used, "c", "left_anti"), F.col("c")),
        found("lonely_disjoint", groups.groupBy("g").agg(F.count_distinct("c").alias("n")).where("n <= 1"), F.col("g")),
        found("asymmetric_inverse", inverse.join(inverse.select(F.col("q").alias("p"), F.col("p").alias("q")), ["p", "q"], "left_anti"), pair("p", "q")),
        found("redundant_subclass", direct.join(by_other, ["a", "b"], "left_semi"), pair("a", "b")),
    ]
    return reduce(DataFrame.unionByName, rows).distinct()


def fitting_inverses(inverse: DataFrame, properties: DataFrame, subclass: DataFrame) -> DataFrame:
    """p, q and fits: p's range goes with q's domain and p's domain with q's range.

    Sides go together if one is the universal class or neither is given, or if a class of one is, or is below or above, a class of the other; a side
    that only one of them gives does not. properties (p, domain, range; a row for each).
    """
    pairs = inverse.select("p", "q").distinct()
    up = superclasses(subclass).select("a", "b")
    near = up.unionByName(up.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("near", F.lit(True))
    sides = []
    for of_p, of_q in (("range", "domain"), ("domain", "range")):
        own = properties.select("p", F.col(of_p).alias("a")).where("a is not null").distinct()
        other = properties.select(F.col("p").alias("q"), F.col(of_q).alias("b")).where("b is not null").distinct()
        both = pairs.join(own, "p", "left").join(other, "q", "left").join(near, ["a", "b"], "left")
        has_a, has_b = F.count("a") > 0, F.count("b") > 0
        universal = F.coalesce(F.max((F.col("a") == THING) | (F.col("b") == THING)), F.lit(False))
        meets = F.coalesce(F.max(F.coalesce(F.col("near"), F.col("a") == F.col("b"))), F.lit(False))
        sides.append(both.groupBy("p", "q").agg((universal | (~has_a & ~has_b) | meets).alias("fits")))
    return sides[0].unionByName(sides[1]).groupBy("p", "q").agg(F.min("fits").alias("fits"))


def inverse_complete_fitting(triples: DataFrame, inverse: DataFrame, properties: DataFrame, subclass: DataFrame) -> DataFrame:
    """Triples with the missing inverse edges of both directions, of inverses that fit."""
    return inverse_complete(triples, fitting_inverses(inverse, properties, subclass).where("fits").select("p", "q"))


def interlinking(schema: DataFrame, own: str, vocabularies: list[str]) -> DataFrame:
    """One row on how a schema's triples (s, p, o, o_kind; p by local name) refer to other vocabularies, IRI prefixes: shares in percent, imports, score, passed.

    An import counts only if a term below its namespace that the schema refers to has triples of its own, or none is referred to. Score: 30 for imports that count, 40 from
    5 % of objects (20 from 1 %), 30 from 10 % of superclasses (15 from 3 %); 60 passes.
    """
    outside = ~F.col("o").startswith(own) & reduce(Column.__or__, [F.col("o").startswith(v) for v in vocabularies], F.lit(False))
    iris = schema.where("o_kind = 'iri'")
    imports = iris.where("p = 'imports'").select(F.col("o").alias("prefix")).distinct()
    share = lambda n, total: F.when(total > 0, n * 100.0 / total).otherwise(0.0)
    above = F.col("p") == "subClassOf"
    counted = iris.agg(
        share(F.count_if(outside), F.count("*")).alias("external_pct"), share(F.count_if(above & outside), F.count_if(above)).alias("superclass_pct"),
        F.count_distinct(F.when(F.col("p") == "imports", F.col("o"))).alias("n_imports"),
    )
    terms = iris.select("o").distinct().join(imports, F.col("o") == F.col("prefix"), "left_anti")
    lengths = sorted(r[0] for r in imports.select(F.length("prefix")).distinct().collect())  # of the prefixes that a schema imports
    starts = terms.select("o", F.explode(F.array(*[F.substring("o", 1, n) for n in lengths]).cast("array<string>")).alias("prefix"))
    below = starts.join(imports, "prefix", "left_semi").select("o").distinct()
    known = below.join(schema.select(F.col("s").alias("o")).distinct().withColumn("own", F.lit(True)), "o", "left")
    of_imports = known.agg(F.count("*").alias("n_referenced"), F.count("own").alias("n_resolved"))
    one = counted.join(F.broadcast(of_imports))  # one row each
    inert = (F.col("n_imports") > 0) & (F.col("n_referenced") > 0) & (F.col("n_resolved") == 0)
    score = F.when((F.col("n_imports") > 0) & ~inert, 30).otherwise(0) + F.when(F.col("external_pct") >= 5, 40).when(F.col("external_pct") >= 1, 20).otherwise(0)
    score = score + F.when(F.col("superclass_pct") >= 10, 30).when(F.col("superclass_pct") >= 3, 15).otherwise(0)
    rounded = {c: F.round(c, 2) for c in ("external_pct", "superclass_pct")}
    return one.withColumns({"inert": inert, "score": score, "passed": score >= 60}).withColumns(rounded)


def cardinality_sync(schema: DataFrame, shapes: DataFrame) -> DataFrame:
    """c, p, status of restrictions and shapes (both c, p, low, high; null for no bound): same, differs, only_schema, only_shapes. Without any shape nothing is compared."""
    a = schema.select("c", "p", F.struct("low", "high").alias("x"))
    b = shapes.select("c", "p", F.struct("low", "high").alias("y"))
    status = F.when(F.col("y").isNull(), "only_schema").when(F.col("x").isNull(), "only_shapes").when(F.col("x").eqNullSafe(F.col("y")), "same").otherwise("differs")
    any_shape = shapes.limit(1).select(F.lit(1).alias("any"))
    return a.join(b, ["c", "p"], "full").select("c", "p", status.alias("status"), F.lit(1).alias("any")).join(any_shape, "any", "left_semi").drop("any")


def shape_violations(triples: DataFrame, shapes: DataFrame, subclass: DataFrame) -> DataFrame:
    """c, p, n_members, n_bad: members of a shape's class, subclasses counted, with fewer distinct values than low, more than high, or none of the class target.

    shapes (c, p, low, high, target); a null bound or target asks nothing. Members without any value count as zero.
    """
    up = superclasses(subclass)
    ty = triples.where("p = 'type'").select("s", F.col("o").alias("c")).distinct()
    closed = ty.join(up.select(F.col("a").alias("c"), F.col("b").alias("above")), "c").select("s", F.col("above").alias("c")).unionByName(ty).distinct()
    members = closed.join(shapes, "c")
    own = triples.where("p <> 'type'").join(shapes.select("p").distinct(), "p", "left_semi").select("s", "p", "o", "o_kind")
    n = own.groupBy("s", "p").agg(F.count_distinct("o").alias("n"))
    typed = own.where("o_kind = 'iri'").join(closed.select(F.col("s").alias("o"), F.col("c").alias("target")).join(shapes.select("target").distinct(), "target", "left_semi"), "o")
    hit = typed.select("s", "p", "target").distinct().withColumn("hit", F.lit(True))
    n_of = F.coalesce("n", F.lit(0))
    bad = F.coalesce(n_of < F.col("low"), F.lit(False)) | F.coalesce(n_of > F.col("high"), F.lit(False)) | (F.col("target").isNotNull() & F.col("hit").isNull())
    return members.join(n, ["s", "p"], "left").join(hit, ["s", "p", "target"], "left").groupBy("c", "p").agg(F.count("*").alias("n_members"), F.count_if(bad).alias("n_bad"))


def blind_spots(trials: DataFrame) -> DataFrame:
    """category, n_mutants, n_caught of categories with a mutant that no check caught; trials (mutant, category, check, caught), a row for each check tried on an applied mutant."""
    each = trials.groupBy("category", "mutant").agg(F.max("caught").alias("caught"))
    return each.groupBy("category").agg(F.count("*").alias("n_mutants"), F.count_if("caught").alias("n_caught")).where("n_caught < n_mutants")


def dead_checks(trials: DataFrame, fired: DataFrame, relevant: DataFrame, unprobed: list[str], least: int = 8) -> DataFrame:
    """check, exposure, n_baseline_failing and verdict of checks that caught no mutant and are not among those that fired (check).

    trials also has adds (the mutant adds triples) and healthy (the check passed before it). Exposed is a check by mutants that add and whose category can
    reach it, relevant (category, check). Verdicts: no_probe_available for unprobed, structurally_undetectable where the baseline failed as often as the check was
    exposed, insufficient_exposure below least, else consider_removal.
    """
    reach = relevant.select("category", "check").distinct().withColumn("reach", F.lit(True))
    each = trials.join(reach, ["category", "check"], "left").groupBy("check").agg(
        F.count_if("caught").alias("n_caught"), F.count_if(F.col("adds") & F.col("reach")).alias("exposure"), F.count_if(~F.col("healthy")).alias("n_baseline_failing"),
    )
    failing = (F.col("n_baseline_failing") > 0) & (F.col("n_baseline_failing") == F.col("exposure"))
    verdict = F.when(F.col("check").isin(unprobed), "no_probe_available").when(failing, "structurally_undetectable")
    verdict = verdict.when(F.col("exposure") < least, "insufficient_exposure").otherwise("consider_removal")
    return each.where("n_caught = 0").join(fired, "check", "left_anti").select("check", "exposure", "n_baseline_failing", verdict.alias("verdict"))


#: Rounds of folding at most; what would fold later stays, which only costs time.
FOLDS = 3


def _folded(both: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(core, hung, rounds): edges (a, b; both ways) without the trees that hang from them by one edge and hold no source.

    A round folds each node with one edge into its neighbour: rounds hold node, parent and n, the nodes folded into it before. hung (node, n): the nodes
    folded into a node of the core.
    """
    core, rounds = both, []
    hung = both.select(F.col("a").alias("node"), F.lit(0).cast("long").alias("n")).limit(0)
    for _ in range(FOLDS):
        single = core.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("_n"), F.min("b").alias("parent")).where("_n = 1").drop("_n").join(sources, "node", "left_anti")
        turned = single.select(F.col("node").alias("parent"), F.col("parent").alias("node"))
        single = single.join(turned.where("node < parent"), ["node", "parent"], "left_anti")  # of two with one edge between them, one stays
        leaves = stored(single.join(hung, "node", "left").select("node", "parent", F.coalesce("n", F.lit(0)).alias("n")), "folded")
        if leaves.isEmpty():
            break
        rounds.append(leaves)
        gone = leaves.select("node")
        new = leaves.groupBy(F.col("parent").alias("node")).agg(F.sum(F.col("n") + 1).alias("n"))
        hung = stored(hung.join(gone, "node", "left_anti").unionByName(new).groupBy("node").agg(F.sum("n").alias("n")), "hung")
        core = core.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
        core = stored(core.select("a", "b"), "core")
    return core, hung, rounds


def _walked(core: DataFrame, hung: DataFrame, sources: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(at, shares): distances (source, node, d), and (source, node, share), a table a level, of shortest paths of core (a, b; both ways): how many nodes' paths from the source pass a node, those that hang from it included.

    Paths are counted level by level outward and their shares carried back, each level one join and one table.
    """
    at = stored(distances(core, sources), "distances")
    deepest = at.agg(F.max("d")).first()[0] or 0
    near = at.select("source", F.col("node").alias("a"), F.col("d").alias("from"))
    far = at.select("source", F.col("node").alias("b"), F.col("d").alias("to"))
    dag = stored(near.join(core, "a").join(far, ["source", "b"]).where(F.col("to") == F.col("from") + 1).select("source", "a", "b", "to"), "paths", "to")
    counts = [stored(at.where("d = 0").select("source", "node", F.lit(1.0).alias("ways")), "ways")]
    for d in range(1, deepest + 1):
        step = dag.where(F.col("to") == d).join(counts[-1].withColumnRenamed("node", "a"), ["source", "a"])
        counts.append(stored(step.groupBy("source", F.col("b").alias("node")).agg(F.sum("ways").alias("ways")), "ways"))
    beneath = F.coalesce("n", F.lit(0)).cast("double")
    shares = [stored(counts[deepest].join(hung, "node", "left").select("source", "node", "ways", beneath.alias("share")), "shares")]
    for d in range(deepest, 0, -1):
        beyond = shares[-1].select("source", F.col("node").alias("b"), ((1 + F.col("share")) / F.col("ways")).alias("part"))
        back = dag.where(F.col("to") == d).join(beyond, ["source", "b"]).groupBy("source", F.col("a").alias("node")).agg(F.sum("part").alias("part"))
        own = counts[d - 1].join(back, ["source", "node"], "left").join(hung, "node", "left")
        shares.append(stored(own.select("source", "node", "ways", (F.coalesce(F.col("ways") * F.col("part"), F.lit(0.0)) + beneath).alias("share")), "shares"))
    discard(dag, *counts)
    return at, shares


def betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node, betweenness over undirected edges (a, b), from the given sources (node): the share of shortest paths that pass a node, summed over sources and targets, times nodes / sources.

    Divided by (n - 1)(n - 2), as both ways of a pair are counted. Trees that hang by one edge are first folded into what they hang from: every path to
    them passes it. In the rest, paths are counted level by level, so rows grow with sources times nodes of the rest; ends of a path don't count.
    Nodes that no path passes have 0. exact_betweenness takes every node as a source.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "both")
    sources = stored(sources.select("node").distinct(), "sources")
    core, hung, folds = _folded(both, sources)
    at, shares = _walked(core, hung, sources)
    passed = [reduce(DataFrame.unionByName, shares).where("source <> node").groupBy("node").agg(F.sum("share").alias("share"))]
    reached = at.groupBy(F.col("node").alias("parent")).agg(F.count("*").alias("sources"))
    for leaves in reversed(folds):  # a source that reaches what a tree hangs from reaches all of the tree
        own = stored(leaves.where("n > 0").join(reached, "parent").select("node", "n", "sources"), "reached")
        passed.append(own.select("node", (F.col("n") * F.col("sources")).cast("double").alias("share")))
        reached = reached.unionByName(own.select(F.col("node").alias("parent"), "sources"))
    nodes = both.select(F.col("a").alias("node")).distinct()
    n, k = nodes.count(), sources.count()
    scale = n / (k * (n - 1) * (n - 2)) if k and n > 2 else 0.0
    return nodes.join(reduce(DataFrame.unionByName, passed), "node", "left").select("node", (F.coalesce("share", F.lit(0.0)) * scale).alias("betweenness"))


#: Rounds of folding at most where every node is a source; what would fold later is walked, which only costs time.
WHOLE_FOLDS = 64
#: Rows (source, node) that one batch of sources makes at most, about.
BATCH_ROWS = 200_000_000


def _ends(links: DataFrame) -> DataFrame:
    """(node, other) of links (a, b) from either end."""
    return links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))


def _hanging() -> tuple[Column, Column]:
    return F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("squares", F.lit(0.0)).alias("squares")


def _folded_whole(links: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(core, hung, rounds): links (a < b) without the trees that hang from them by one link; of a tree of its own one node stays, without links.

    A round folds each node with one link into its neighbour: rounds hold node, parent, n and squares, the nodes folded into it before and the sum of the squared
    sizes of the branches that they make. hung (node, n, squares): the same of the nodes that stay. A round deals the links twice: by node, to find nodes
    with one link, and by link, where those meet their own.
    """
    core, rounds, none = links, [], (F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("squares"))
    hung = stored(links.limit(0).select(F.col("a").alias("node"), *none), "hung")
    for _ in range(WHOLE_FOLDS):
        single = _ends(core).groupBy("node").agg(F.count("*").alias("k"), F.min("other").alias("other")).where("k = 1")
        told = single.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "node")
        # of two nodes with one link between them, the greater is folded
        met = stored(core.withColumn("node", F.lit(None).cast("string")).unionByName(told).groupBy("a", "b").agg(F.max("node").alias("node")), "links")
        leaves = met.where("node is not null").select("node", F.when(F.col("node") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("parent"))
        if leaves.isEmpty():
            break
        # of the first round, nothing hangs from a node yet
        own = leaves.join(hung, "node", "left").select("node", "parent", *_hanging()) if rounds else leaves.select("node", "parent", *none)
        rounds.append(stored(own, "folded"))
        branch = (F.col("n") + 1).cast("double")
        new = rounds[-1].groupBy(F.col("parent").alias("node")).agg(F.sum(F.col("n") + 1).alias("n"), F.sum(branch * branch).alias("squares"))
        if len(rounds) > 1:
            new = hung.join(leaves.select("node"), "node", "left_anti").unionByName(new).groupBy("node").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"))
        hung = stored(new, "hung")
        core = met.where("node is null").select("a", "b")
    return core, hung, rounds


def exact_betweenness(edges: DataFrame) -> DataFrame:
    """node, betweenness over undirected edges (a, b): the share of shortest paths that pass a node, summed over all pairs of other nodes, divided by (n - 1)(n - 2), as both ways of a pair are counted.

    A node that is cut from n nodes in branches of sizes b by taking it from a tree that hangs there lies between all that it parts: n (2 N - n - 2) - sum of b squared, of a
    component of N nodes. So trees are folded, in time proportional to their links, and a forest is done with that. Only what stays, without nodes of one link, is
    walked from each of its nodes, each standing for those that hang from it; that is quadratic in what stays, and goes in batches of sources.
    """
    links = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    core, hung, folds = _folded_whole(links)
    inner = stored(_ends(core).select("node").distinct(), "core")
    kept = stored(inner.join(hung, "node", "left").select("node", *_hanging()), "kept")  # nodes that stay with links
    alone = hung.join(inner, "node", "left_anti").select("node", "n", "squares", (F.col("n") + 1).alias("total"), F.lit(0.0).alias("walks"))
    walked, n_inner = [], inner.count()
    both = core.unionByName(core.select(F.col("b").alias("a"), F.col("a").alias("b")))
    batches = -(-n_inner * n_inner // BATCH_ROWS)
    for k in range(batches):
        at, shares = _walked(both, hung, inner.where(F.pmod(F.xxhash64("node"), F.lit(batches)) == k))
        totals = stored(at.join(kept, "node").groupBy("source").agg(F.sum(F.col("n") + 1).alias("total")), "totals")
        weights = kept.select(F.col("node").alias("source"), (F.col("n") + 1).alias("weight"))
        passed = reduce(DataFrame.unionByName, shares).where("source <> node").join(kept.select("node", "n"), "node").join(weights, "source").groupBy("node").agg(F.sum((F.col("share") - F.col("n")) * F.col("weight")).alias("walks"))
        walked.append((totals.withColumnRenamed("source", "node"), stored(passed, "walks")))
        discard(at, *shares)
    held = alone
    if walked:
        totals, walks = (reduce(DataFrame.unionByName, x) for x in zip(*walked, strict=True))
        walks = walks.groupBy("node").agg(F.sum("walks").alias("walks"))
        held = held.unionByName(kept.join(totals, "node").join(walks, "node", "left").select("node", "n", "squares", "total", F.coalesce("walks", F.lit(0.0)).alias("walks")))
    held = stored(held, "held")
    found, above = [held], held.select(F.col("node").alias("parent"), "total")
    for leaves in reversed(folds):  # what hangs from a node is of its component
        own = stored(leaves.where("n > 0").join(above, "parent").select("node", "n", "squares", "total", F.lit(0.0).alias("walks")), "held")
        found.append(own)
        above = above.unionByName(own.select(F.col("node").alias("parent"), "total"))
    n = held.count() + sum(leaves.count() for leaves in folds)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    lies = F.col("n").cast("double") * (2 * F.col("total") - F.col("n") - 2) - F.col("squares") + F.col("walks")
    ends = [leaves.where("n = 0").select("node", F.lit(0.0).alias("betweenness")) for leaves in folds]
    return reduce(DataFrame.unionByName, [*[x.select("node", (lies * scale).alias("betweenness")) for x in found], *ends])
