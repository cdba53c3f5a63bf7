"""Canonical labels of blank nodes against isomorphism by trying all orders."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import analytics as an
from graphloom.operators import blank as bl

SPO = "s string, p string, o string, o_kind string, o_dt string"


def renamed(rows, seed):
    names = sorted({x for s, _, o, k, _ in rows for x in ((s,) if k == "lit" else (s, o)) if x.startswith("_:")})
    to = dict(zip(names, random.Random(seed).sample([f"_:z{k}" for k in range(50)], len(names)), strict=True))
    return [(to.get(s, s), p, o if k == "lit" else to.get(o, o), k, dt) for s, p, o, k, dt in rows]


def isomorphic(a, b):
    blank = lambda rows: sorted({x for s, _, o, k, _ in rows for x in ((s,) if k == "lit" else (s, o)) if x.startswith("_:")})
    one, two = blank(a), blank(b)
    if len(one) != len(two) or len(set(a)) != len(set(b)):
        return False
    for order in itertools.permutations(two):
        to = dict(zip(one, order, strict=True))
        if {(to.get(s, s), p, o if k == "lit" else to.get(o, o), k, dt) for s, p, o, k, dt in a} == set(b):
            return True
    return False


def link(s, o, p="p"):
    return (s, p, o, "bnode" if o.startswith("_:") else "iri", None)


def test_labels_do_not_depend_on_the_given_ones(spark):
    ring = lambda names: [link(f"_:{a}", f"_:{b}") for a, b in zip(names, names[1:] + names[0], strict=True)]
    hub = [x for k in range(4) for x in (link("hub", f"_:m{k}"), link(f"_:m{k}", f"_:l{k}"), (f"_:l{k}", "v", "_:1", "lit", "int"))]
    graphs = {
        "six": ring("abcdef") + hub, "two threes": ring("abc") + ring("def") + hub,
        "marked": ring("abcdef") + [link("_:a", "x", "q"), link("_:c", "x", "q")] + hub, "marked apart": ring("abcdef") + [link("_:a", "x", "q"), link("_:d", "x", "q")] + hub,
        "loop": [link("_:a", "_:a"), link("_:b", "_:c"), link("_:c", "_:b")], "no loop": [link("_:a", "_:b"), link("_:b", "_:a"), link("_:c", "_:c"), link("_:c", "n", "q")],
    }
    df = lambda rows: spark.createDataFrame(rows, SPO)
    lines = {k: frozenset(tuple(r) for r in bl.canonical(df(rows)).collect()) for k, rows in graphs.items()}
    assert len(set(lines.values())) == len(graphs) and all(len(lines[k]) == len(set(rows)) for k, rows in graphs.items())
    for k in ("two threes", "loop"):
        again = bl.canonical(df(renamed(graphs[k], 3)))
        assert frozenset(tuple(r) for r in again.collect()) == lines[k]


def test_random_graphs_are_equal_where_an_order_makes_them_so(spark):
    rng = random.Random(8)
    parts = [[link(f"_:{rng.choice('abcd')}", f"_:{rng.choice('abcd')}", rng.choice("pq")) for _ in range(5)] for _ in range(3)]
    parts += [renamed(parts[0], 1), renamed(parts[1], 2)]
    lines = [frozenset(tuple(r) for r in bl.canonical(spark.createDataFrame(rows, SPO)).collect()) for rows in parts]
    for (a, x), (b, y) in itertools.combinations(zip(parts, lines, strict=True), 2):
        assert (x == y) == isomorphic(a, b)


def test_graphs_without_blank_nodes_stay(spark):
    rows = [("a", "p", "b", "iri", None), ("a", "p", "_:b", "lit", None), ("a", "p", "b", "iri", None)]
    assert {tuple(r) for r in bl.canonical(spark.createDataFrame(rows, SPO)).collect()} == set(rows)
    assert bl.canonical(spark.createDataFrame([], SPO)).collect() == []
    assert bl.same_graph(spark.createDataFrame([link("_:a", "x")], SPO), spark.createDataFrame([link("_:b", "x")], SPO))


def test_relabelling_keeps_repeats_that_the_digest_takes_once(spark):
    rows = [("a", "p", "b", "iri", None)] * 3 + [link("_:x", "a"), link("a", "_:x")]
    bag = bl.relabelled(spark.createDataFrame(rows, SPO))
    assert bag.count() == 5 and bl.canonical(spark.createDataFrame(rows, SPO)).count() == 3
    assert an.graph_hash(bag).first() == an.graph_hash(bag.distinct()).first()


def test_sums_are_equal_where_canonical_graphs_are(spark):
    rng = random.Random(3)
    ring = [link(f"_:{a}", f"_:{b}") for a, b in zip("abcdef", "bcdefa", strict=True)]
    twos = [link(f"_:{a}", f"_:{b}") for a, b in zip("abcdef", "bcaefd", strict=True)]
    plain = [("x", "p", "y", "iri", None), ("x", "p", "_:b", "lit", None), ("y", "q", "1", "lit", "int")]
    some = [link(f"_:{rng.choice('abc')}", rng.choice(["_:a", "_:d", "k"]), rng.choice("pq")) for _ in range(6)] + [link("k", "_:a"), link("k", "_:d")]
    graphs = [plain + ring, plain + renamed(ring, 2) * 2, plain + twos, ring, plain, [], plain + some, plain + renamed(some, 4), plain + some[:-1]]
    told = [bl.digest(bl.sums(spark.createDataFrame(rows, SPO))).first() for rows in graphs]
    whole = [bl.canonical(spark.createDataFrame(rows, SPO)) for rows in graphs]
    assert [r.n for r in told] == [x.count() for x in whole] == [len(set(rows)) for rows in graphs]
    lines = [frozenset(tuple(r) for r in x.collect()) for x in whole]
    assert all((told[i] == told[j]) == (lines[i] == lines[j]) for i in range(len(graphs)) for j in range(i))
    assert bl.digest(*[bl.sums(spark.createDataFrame(rows, SPO)) for rows in (plain, ring)]).first() == told[0]


def test_triples_are_not_dealt_for_the_sums(spark):
    """What goes to tasks of each line is a hash of eight bytes, and of a blank node's side two sums."""
    rows = spark.range(20_000).select(F.concat(F.lit("Order_"), "id").alias("s"), F.lit("placedBy").alias("p"), F.concat(F.lit("_:"), F.md5((F.col("id") % 2000).cast("string"))).alias("o"), F.lit("bnode").alias("o_kind"))
    lines = []
    real = type(rows).repartition
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(rows), "repartition", lambda df, *by: lines.append(df.columns) or real(df, *by))
        n = bl.digest(bl.sums(rows)).first().n
    assert n == 20_000 and lines == [["key"], ["key"]]
