"""Which checks notice which defects: mutants as signed deltas over one graph, and all checks for all mutants in one grouped plan.

A mutant changes few triples, so only nodes near them can be judged otherwise than before. Each check is a rule over a node's own triples, the types of
what it points to, and how many links lead to it; it is evaluated once for the whole graph, and then, for all mutants together, for the nodes near
their changes. Those that fail now and those that failed in the whole graph differ by what is added to the whole graph's count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.coercion import to_number
from graphloom.storage import discard, stored

TRIPLE = ["s", "p", "o", "o_kind"]
CHECKS = (
    "untyped", "dangling", "domain", "range", "functional", "missing", "literal_on_object", "iri_on_data", "disjoint", "undeclared", "self_link", "unreferenced", "bad_number",
)


#: Names that one long holds, a bit for each.
NAMES_A_LONG = 63


class _Bits:
    """Names of a schema as bits of longs, so that what a node has of them is one bitwise or, however many triples it has."""

    def __init__(self, names: set[str]) -> None:
        self.at = {n: divmod(k, NAMES_A_LONG) for k, n in enumerate(sorted(names))}

    def of(self, name: Column, prefix: str) -> list[Column]:
        """Aggregates: all names that occur, as columns prefix_0 and so on."""
        found: dict[int, list[Column]] = {0: []}
        for n, (chunk, bit) in self.at.items():
            found.setdefault(chunk, []).extend((F.lit(n), F.lit(1 << bit)))
        one = lambda pairs: F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(0).cast("long")) if pairs else F.lit(0).cast("long")
        return [F.bit_or(one(pairs)).alias(f"{prefix}_{chunk}") for chunk, pairs in found.items()]

    def has(self, name: str, prefix: str) -> Column:
        chunk, bit = self.at[name]
        return F.col(f"{prefix}_{chunk}").bitwiseAND(F.lit(1 << bit)) != 0


def _any(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def _schema_rows(schema: dict[str, DataFrame]) -> dict[str, list[tuple]]:
    """The tables of a schema on the driver, which only composes plans of them."""
    order = {"domain": "pc", "range": "pc", "object_property": "p", "data_property": "p", "functional": "p", "number": "p", "required": "cp", "disjoint": "ab", "referenced": "c"}
    sides = [schema[k].select(F.lit(k).alias("k"), F.col(c[0]).alias("a"), (F.col(c[1]) if len(c) > 1 else F.lit("")).alias("b")) for k, c in order.items()]
    out: dict[str, list[tuple]] = {k: [] for k in order}
    for r in reduce(DataFrame.unionByName, sides).distinct().collect():
        out[r.k].append((r.a, r.b))
    return out


def bad_nodes(t: DataFrame, types: DataFrame, incoming: DataFrame, schema: dict[str, DataFrame]) -> DataFrame:
    """m, check, node: the nodes of each mutant m that fail a check, each once.

    t (m, s, p, o, o_kind): all triples of the nodes to judge, types included; types (m, node, c): those of the ends of their links; incoming (m, node, n):
    the number of links that lead to them. schema: domain and range (p, c), object_property, data_property, functional and number (p), required (c, p),
    disjoint (a, b), referenced (c). untyped: no type. dangling, range: a link to a node without a type, or with types but not the range. domain:
    a property of another class. functional: several values. missing: a class's required property is absent. unreferenced: of such a class, and
    no link leads there. bad_number: no number where one is due. The others are as named.

    All that a node's own triples tell is one grouping by node; its links meet the types of their ends in one join.
    """
    rows = _schema_rows(schema)
    names = lambda *keys: [p for k in keys for p, _ in rows[k]]
    plain, lit, iri = F.col("p") != "type", F.col("o_kind") == "lit", F.col("o_kind") == "iri"
    flags = {
        "untyped": plain, "literal_on_object": plain & lit & F.col("p").isin(names("object_property")), "iri_on_data": plain & iri & F.col("p").isin(names("data_property")),
        "undeclared": plain & ~F.col("p").isin(names("object_property", "data_property")), "self_link": plain & iri & (F.col("s") == F.col("o")),
        "bad_number": plain & lit & F.when(F.col("p").isin(names("number")), to_number(F.col("o")).isNull()).otherwise(False),
    }
    classes = _Bits({c for _, c in rows["domain"]} | {c for c, _ in rows["required"]} | {c for pair in rows["disjoint"] for c in pair} | {c for c, _ in rows["referenced"]})
    filled = _Bits({p for p, _ in rows["domain"]} | {p for _, p in rows["required"]})
    own = t.groupBy("m", "s").agg(
        F.max(~plain).alias("typed"), *[F.max(x).alias(k) for k, x in flags.items()],
        *classes.of(F.when(~plain, F.col("o")), "c"), *filled.of(F.when(plain, F.col("p")), "p"),
    )
    is_a, has = lambda c: classes.has(c, "c"), lambda p: filled.has(p, "p")
    reached = incoming.where("n > 0").select("m", F.col("node").alias("s"), F.lit(True).alias("reached"))
    failed = {k: F.col(k) for k in flags} | {
        "untyped": F.col("untyped") & ~F.col("typed"),
        "domain": _any([has(p) & ~is_a(c) for p, c in rows["domain"]]),
        "missing": _any([is_a(c) & ~has(p) for c, p in rows["required"]]),
        "disjoint": _any([is_a(a) & is_a(b) for a, b in rows["disjoint"]]),
        "unreferenced": _any([is_a(c) for c, _ in rows["referenced"]]) & F.col("reached").isNull(),
    }
    told = lambda found: F.explode(F.array_compact(F.array(*[F.when(x, F.lit(k)) for k, x in found.items()])))
    of_node = own.join(reached, ["m", "s"], "left").select("m", told(failed).alias("check"), F.col("s").alias("node"))

    targets = _Bits({c for _, c in rows["range"]})
    ends = types.groupBy("m", F.col("node").alias("o")).agg(F.lit(True).alias("typed"), *targets.of(F.col("c"), "c"))
    aimed = t.where("o_kind = 'iri' and p <> 'type'").select("m", "s", "p", "o").join(ends, ["m", "o"], "left")
    missed = {"dangling": F.col("typed").isNull(), "range": F.col("typed") & _any([(F.col("p") == p) & ~targets.has(c, "c") for p, c in rows["range"]])}
    of_links = aimed.select("m", told(missed).alias("check"), F.col("s").alias("node")).distinct()

    value = F.struct("o", "o_kind")
    several = t.where(plain & F.col("p").isin(names("functional"))).groupBy("m", "s", "p").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo <> hi")
    of_values = several.select("m", F.lit("functional").alias("check"), F.col("s").alias("node")).distinct()
    return of_node.unionByName(of_links).unionByName(of_values)


def _signed(deltas: DataFrame, sign: int) -> DataFrame:
    return deltas.where(F.col("sign") == sign).select("m", *TRIPLE).distinct()


def sensitivity(t: DataFrame, deltas: DataFrame, schema: dict[str, DataFrame]) -> DataFrame:
    """mutant, check, before, after, noticed for every mutant and check: failing nodes of the graph, and of the graph with the mutant's changes.

    t (s, p, o, o_kind) without repeated triples; deltas (m, sign, s, p, o, o_kind): triples that mutant m takes away (-1, which t has) or adds (1, which it lacks).
    noticed: more nodes fail than before. Nodes near a change: its subject, what it points to, and what points to a node whose types change.
    """
    base = t.select(*TRIPLE)
    gone, new = stored(_signed(deltas, -1), "gone", "p"), stored(_signed(deltas, 1), "new", "p")
    both = gone.unionByName(new)
    all_types = base.where("p = 'type'").select(F.col("s").alias("node"), F.col("o").alias("c")).distinct()
    links = base.where("o_kind = 'iri' and p <> 'type'")
    degrees = stored(links.groupBy(F.col("o").alias("node")).agg(F.count("*").alias("n")), "incoming")
    bad = bad_nodes(base.withColumn("m", F.lit("")), all_types.withColumn("m", F.lit("")), degrees.withColumn("m", F.lit("")), schema)
    bad = stored(bad.select("check", F.col("node").alias("s")), "bad")
    whole = bad.groupBy("check").agg(F.count("*").alias("before"))

    link_ends = both.where("o_kind = 'iri' and p <> 'type'").select("m", F.col("o").alias("s"))
    retyped = both.where("p = 'type'").select("m", F.col("s").alias("o")).distinct()
    pointing = links.join(retyped, "o").select("m", "s")
    near = stored(both.select("m", "s").union(link_ends).union(pointing).distinct(), "near")
    was = base.join(near, "s").select("m", *TRIPLE)
    now = stored(was.join(gone, ["m", *TRIPLE], "left_anti").unionByName(new), "now")  # new ones are lacking there
    asked = now.where("o_kind = 'iri' and p <> 'type'").select("m", F.col("o").alias("node")).distinct()
    types_was = stored(asked.join(all_types, "node").select("m", "node", "c"), "types")
    as_type = lambda df: df.where("p = 'type'").select("m", F.col("s").alias("node"), F.col("o").alias("c"))
    types_now = types_was.join(as_type(gone), ["m", "node", "c"], "left_anti").unionByName(as_type(new)).distinct()
    in_was = near.select("m", F.col("s").alias("node")).join(degrees, "node").select("m", "node", "n")
    moved = lambda df, x: df.where("o_kind = 'iri' and p <> 'type'").select("m", F.col("o").alias("node"), F.lit(x).cast("long").alias("n"))
    in_now = in_was.unionByName(moved(gone, -1)).unionByName(moved(new, 1)).groupBy("m", "node").agg(F.sum("n").alias("n"))
    counted = lambda rows, x: rows.groupBy("m", "check").agg((F.count("*") * x).alias("n"))
    moves = counted(bad_nodes(now, types_now, in_now, schema), 1).unionByName(counted(near.join(bad, "s"), -1))
    moves = stored(moves.groupBy("m", "check").agg(F.sum("n").alias("n")), "moves")
    names = both.select("m").distinct().withColumn("check", F.explode(F.array(*[F.lit(c) for c in CHECKS])))
    out = names.join(whole, "check", "left").join(moves, ["m", "check"], "left")
    before, after = F.coalesce("before", F.lit(0)), F.coalesce("before", F.lit(0)) + F.coalesce("n", F.lit(0))
    out = stored(out.select(F.col("m").alias("mutant"), "check", before.alias("before"), after.alias("after"), (after > before).alias("noticed")), "sensitivity")
    discard(gone, new, degrees, bad, near, now, types_was, moves)
    return out


def audit(matrix: DataFrame) -> DataFrame:
    """kind, name of a sensitivity matrix: blind_spot, a mutant that no check notices, and dead_check, a check that notices no mutant."""
    of = lambda c, kind: matrix.groupBy(F.col(c).alias("name")).agg(F.bool_or("noticed").alias("_any")).where("not _any").select(F.lit(kind).alias("kind"), "name")
    return of("mutant", "blind_spot").unionByName(of("check", "dead_check"))
