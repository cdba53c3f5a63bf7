"""Repairs of shapes by a stated log, and on random graphs."""

import random

import pytest

from graphloom.operators import shape_repair as sr

T = "s string, p string, o string, o_kind string, o_dt string"
SHAPE = "shape string, c string, p string, kind string, value string, fallback string"
SHAPES = [
    ("size is a number", "Item", "size", "datatype", "decimal", None), ("has a size", "Item", "size", "min", "1", "0"), ("one size", "Item", "size", "max", "1", None),
    ("made when", "Item", "made", "datatype", "dateTime", None), ("in a place", "Item", "at", "class", "Place", None), ("two owners", "Item", "owner", "min", "2", None), ("flag", "Item", "ok", "datatype", "boolean", None),
]
FACTS = [
    ("a", "type", "Item", "iri", None), ("a", "size", " 1_000.50 ", "lit", "string"), ("a", "size", "7", "lit", "decimal"), ("a", "made", "2024-01-02", "lit", "string"), ("a", "at", "p1", "iri", None), ("p1", "type", "Place", "iri", None),
    ("b", "type", "Item", "iri", None), ("b", "size", "N/A", "lit", None), ("b", "ok", "YES", "lit", "string"), ("b", "at", "p2", "iri", None), ("b", "at", "p3", "iri", None), ("p3", "type", "Person", "iri", None),
    ("b", "owner", "x", "iri", None), ("c", "size", "N/A", "lit", None),
]


def test_repairs_are_the_cheapest_and_logged(spark):
    t, shapes, disjoint = spark.createDataFrame(FACTS, T), spark.createDataFrame(SHAPES, SHAPE), spark.createDataFrame([("Place", "Person")], "a string, b string")
    graph, log, rest = sr.repaired(t, shapes, disjoint, infer_types=True)
    assert {tuple(r) for r in log.collect()} == {
        (1, "size is a number", "cast", "a", "size", " 1_000.50 ", "1000.5", "decimal"), (2, "one size", "choose", "a", "size", "7", None, None), (1, "made when", "cast", "a", "made", "2024-01-02", "2024-01-02T00:00:00", "dateTime"),
        (1, "size is a number", "drop", "b", "size", "N/A", None, None), (1, "flag", "cast", "b", "ok", "YES", "true", "boolean"), (1, "in a place", "add", "b", "at", "p2", "Place", None), (2, "has a size", "add", "b", "size", None, "0", "decimal"),
    }
    assert {tuple(r) for r in rest.collect()} == {("in a place", "class", "b", "at", "p3"), ("two owners", "min", "a", "owner", None), ("two owners", "min", "b", "owner", None)}
    assert ("c", "size", "N/A", "lit", None) in {tuple(r) for r in graph.collect()}
    plain = sr.repaired(t, shapes)
    assert {(r.shape, r.o) for r in plain[2].collect() if r.kind == "class"} == {("in a place", "p2"), ("in a place", "p3")}
    assert sr.repaired(t.where("false"), shapes)[1].collect() == []


@pytest.mark.parametrize("seed", [1])
def test_random_graphs_end_with_no_repairable_violation(spark, seed):
    rng = random.Random(seed)
    facts = [(f"n{k}", "type", rng.choice(["Item", "Place"]), "iri", None) for k in range(12)]
    facts += [(f"n{rng.randrange(12)}", rng.choice(["size", "made", "ok"]), rng.choice(["1", "x", "2024-05-06", "true", " 3 "]), "lit", rng.choice([None, "decimal", "string"])) for _ in range(40)]
    facts += [(f"n{rng.randrange(12)}", "at", f"n{rng.randrange(15)}", "iri", None) for _ in range(10)]
    t, shapes = spark.createDataFrame(facts, T), spark.createDataFrame(SHAPES, SHAPE)
    graph, log, rest = sr.repaired(t, shapes, infer_types=True)
    left = sr.violations(graph, shapes).collect()
    assert {(r.shape, r.s, r.p, r.o) for r in left} == {(r.shape, r.s, r.p, r.o) for r in rest.collect()} and {r.kind for r in left} == {"min"} and {r.p for r in left} == {"owner"}
    rows = graph.collect()
    items, sizes = {r.s for r in rows if r.p == "type" and r.o == "Item"}, {}
    for r in rows:
        if r.p == "size" and r.s in items:
            sizes.setdefault(r.s, []).append((float(r.o), r.o_dt))
    assert all(len(sizes[s]) == 1 and sizes[s][0][1] == "decimal" for s in items)


def test_later_rounds_judge_only_what_changed(spark, monkeypatch):
    facts = [*FACTS, *[f for k in range(20) for f in ((f"ok{k}", "type", "Item", "iri", None), (f"ok{k}", "size", "1", "lit", "decimal"))], ("a", "name", "x", "lit", "string")]
    seen, real = [], sr.violations
    monkeypatch.setattr(sr, "violations", lambda t, *rest: (seen.append({r.s for r in t.select("s").collect()}), real(t, *rest))[1])
    graph, _, rest = sr.repaired(spark.createDataFrame(facts, T), spark.createDataFrame(SHAPES, SHAPE))
    assert len(seen) == 3 and len(seen[0]) > 20 and seen[1] == {"a", "b"} and seen[2] == {"a", "b"}
    rows = [tuple(r) for r in graph.collect()]
    assert len(rows) == len(set(rows)) and set(facts) - set(rows) == {("a", "size", " 1_000.50 ", "lit", "string"), ("a", "size", "7", "lit", "decimal"), ("a", "made", "2024-01-02", "lit", "string"), ("b", "size", "N/A", "lit", None), ("b", "ok", "YES", "lit", "string")}
    assert {r.s for r in rest.collect() if r.kind == "min"} == {"a", "b", *[f"ok{k}" for k in range(20)]}
