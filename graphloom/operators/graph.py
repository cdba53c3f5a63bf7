"""Graph patterns over triples (s, p, o, o_kind, o_num) as joins of DataFrames; variables are column names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.pairs import joined_pairs
from graphloom.sources.tables import inline
from graphloom.storage import discard, stored


def match(triples: DataFrame, s: str, p: str, o: str, number: str | None = None, g: str | None = None) -> DataFrame:
    """One triple pattern. ?x binds a variable, other texts are constants; a repeated variable must be equal. number names o's numeric value.

    g is the term of the column g, the graph that a triple stands in; without it, all graphs are read as one.
    """
    bound, names = triples, {}
    for column, term in (("s", s), ("p", p), ("o", o), *([("g", g)] if g is not None else [])):
        if not term.startswith("?"):
            bound = bound.where(F.col(column) == term)
        elif term[1:] in names:
            bound = bound.where(F.col(column) == F.col(names[term[1:]]))
        else:
            names[term[1:]] = column
    extra = [F.col("o_num").alias(number)] if number else []
    return bound.select(*[F.col(c).alias(v) for v, c in names.items()], *extra)


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def join(*parts: DataFrame) -> DataFrame:
    """Natural join of patterns in the given order; a product without a shared variable is refused."""

    def one(a: DataFrame, b: DataFrame) -> DataFrame:
        if not _shared(a, b):
            raise ValueError(f"no shared variable between {a.columns} and {b.columns}")
        return a.join(b, _shared(a, b))

    return reduce(one, parts)


def compatible_join(left: DataFrame, right: DataFrame, unbound: list[str]) -> DataFrame:
    """Natural join in which the shared variables named unbound may be null on either side, and then agree with any value.

    Rows are parted by which of these variables they bind, and each pair of parts is an equi-join on what both bind; a pair that binds
    nothing in common is a product, which is refused unless one side has no such rows.
    """
    shared = _shared(left, right)
    maybe = [v for v in shared if v in unbound]
    part = lambda df, free: df.where(reduce(lambda x, y: x & y, [F.col(v).isNull() if v in free else F.col(v).isNotNull() for v in maybe], F.lit(True)))
    free_sets = [[v for k, v in enumerate(maybe) if bits >> k & 1] for bits in range(2 ** len(maybe))]
    out = []
    for of_left in free_sets:
        for of_right in free_sets:
            on = [v for v in shared if v not in of_left and v not in of_right]
            a, b = part(left, of_left), part(right, of_right)
            if not on:
                if a.isEmpty() or b.isEmpty():
                    continue
                raise ValueError(f"rows that bind none of {shared} would meet all others")
            a, b = a.drop(*[v for v in shared if v in of_left and v not in of_right]), b.drop(*of_right)
            out.append(a.join(b, on) if on else a)
    return reduce(DataFrame.unionByName, out)


def optional(left: DataFrame, right: DataFrame, condition: Column | None = None) -> DataFrame:
    """Left outer join; a filter of the optional part belongs to the join and may name the variables of both sides."""
    shared = _shared(left, right)
    if condition is None:
        return left.join(right, shared, "left")
    of_right = {v: f"_right_{v}" for v in shared}
    on = reduce(lambda x, y: x & y, [F.col(v) == F.col(own) for v, own in of_right.items()], condition)
    return left.join(right.withColumnsRenamed(of_right), on, "left").drop(*of_right.values())


def exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, _shared(left, right), "left_semi")


def not_exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, _shared(left, right), "left_anti")


def union(*parts: DataFrame) -> DataFrame:
    """Bag union; variables that a part lacks stay unbound."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def values(left: DataFrame, variables: str | list[str], rows: list) -> DataFrame:
    """Join with an inline table of one variable (rows are terms) or several (rows are tuples, None for UNDEF)."""
    names = [variables] if isinstance(variables, str) else variables
    told = [(r,) if isinstance(variables, str) else tuple(r) for r in rows]
    given = inline(left.sparkSession, told, ", ".join(f"{v} string" for v in names))
    undefined = [v for k, v in enumerate(names) if any(r[k] is None for r in told)]
    return compatible_join(left, F.broadcast(given), undefined) if undefined else left.join(F.broadcast(given), names)  # a literal list


def group_concat(column: str, separator: str = " ") -> Column:
    """Aggregate: the bound values of a group as one text, in order, so that reruns agree. Meant for groups that fit a row."""
    return F.array_join(F.sort_array(F.collect_list(column)), separator)


def sample(column: str) -> Column:
    """Aggregate: any value of a group; here the least, so that reruns agree."""
    return F.min(column)


def ask(df: DataFrame) -> bool:
    return not df.isEmpty()


def construct(df: DataFrame, *templates: tuple[str, str, str]) -> DataFrame:
    """The set of triples that templates make of bindings; unbound terms make none."""
    term = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
    made = [df.select(*[term(t).alias(c) for t, c in zip(x, "spo", strict=True)]) for x in templates]
    return union(*made).dropna().distinct()


def transitive(edges: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) linked by one or more edges (a, b): semi-naive, each round joins only what is new; cycles end.

    What is known is the union of the rounds' tables: none is written twice.
    """
    edges = stored(edges.select("a", "b").distinct(), "edges")
    rounds, ahead = [edges], edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
    while not rounds[-1].isEmpty():
        step = rounds[-1].join(ahead, "b").select("a", F.col("c").alias("b")).distinct()
        rounds.append(stored(step.join(reduce(DataFrame.unionByName, rounds), ["a", "b"], "left_anti"), "closure"))
    discard(rounds.pop())
    return reduce(DataFrame.unionByName, rounds) if rounds else edges.limit(0)


def step(triples: DataFrame, *predicates: str) -> DataFrame:
    """Pairs (a, b) of one step by a predicate, or by any of several: the path p, or p | q."""
    return triples.where(F.col("p").isin(*predicates)).select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()


def inverse_path(pairs: DataFrame) -> DataFrame:
    """The path ^x."""
    return pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))


def sequence_path(first: DataFrame, *then: DataFrame) -> DataFrame:
    """The path x / y / ..., as distinct pairs."""
    after = lambda x, y: joined_pairs(x, y.select(F.col("a").alias("b"), F.col("b").alias("c"))).withColumnRenamed("c", "b")
    return reduce(after, then, first) if then else first.distinct()


def maybe_path(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The path x?: the pairs, and every node (node) with itself."""
    return pairs.select("a", "b").union(nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))).distinct()


def star_path(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The path x*."""
    return maybe_path(transitive(pairs), nodes)


def path_plus(triples: DataFrame, p: str, a: str, b: str) -> DataFrame:
    """Pairs by property path p+ as variables a and b."""
    return transitive(step(triples, p)).select(F.col("a").alias(a), F.col("b").alias(b))


def insert(triples: DataFrame, made: DataFrame) -> DataFrame:
    return triples.unionByName(made, allowMissingColumns=True).dropDuplicates(["s", "p", "o"])


def delete(triples: DataFrame, gone: DataFrame) -> DataFrame:
    return triples.join(gone.select("s", "p", "o"), ["s", "p", "o"], "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b): least node reachable, by label propagation with a pointer jump each round."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "both")
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "label")
    held = label
    while True:
        best = both.join(label.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        moved = label.join(best, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        jump = label.select(F.col("node").alias("j"), F.col("component").alias("further"))
        moved = stored(moved.join(jump, F.col("component") == F.col("j"), "left").select("node", "old", F.least("component", "further").alias("component")), "label")
        discard(held)
        if moved.where("old <> component").isEmpty():
            discard(both)
            return moved.select("node", "component")
        label, held = moved.select("node", "component"), moved
