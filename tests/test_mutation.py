"""The mutation audit on a small graph, against the checks run on each mutant's whole graph."""

from graphloom.operators import mutation as mu

T = "s string, p string, o string, o_kind string"
FACTS = [("a", "type", "A", "iri"), ("b", "type", "B", "iri"), ("c", "type", "B", "iri"), ("a", "to", "b", "iri"), ("a", "size", "1", "lit"), ("z", "to", "c", "iri")]
DELTAS = [
    ("lost", -1, "b", "type", "B", "iri"), ("moved", -1, "a", "to", "b", "iri"), ("moved", 1, "a", "to", "a", "iri"), ("typed", 1, "z", "type", "A", "iri"), ("typed", 1, "z", "type", "B", "iri"), ("words", -1, "a", "size", "1", "lit"), ("words", 1, "a", "size", "one", "lit"), ("same", 1, "a", "size", "1.0", "lit"),
]


def test_sensitivity_is_that_of_whole_graphs(spark):
    of = lambda rows, columns: spark.createDataFrame(rows, columns)
    one = lambda *names: of([(n,) for n in names], "p string")
    schema = {
        "domain": of([("to", "A"), ("size", "A")], "p string, c string"), "range": of([("to", "B")], "p string, c string"), "object_property": one("to"), "data_property": one("size"), "functional": one("size"), "number": one("size"),
        "required": of([("A", "size")], "c string, p string"), "disjoint": of([("A", "B")], "a string, b string"), "referenced": of([("B",)], "c string"),
    }
    matrix = mu.sensitivity(of(FACTS, T), of(DELTAS, "m string, sign int, " + T), schema)
    found = {(r.mutant, r.check): (r.before, r.after) for r in matrix.collect()}
    assert len(found) == 5 * len(mu.CHECKS)
    for m in ("lost", "moved", "typed", "words", "same"):
        gone = [d[2:] for d in DELTAS if d[0] == m and d[1] < 0]
        rows = [f for f in FACTS if f not in gone] + [d[2:] for d in DELTAS if d[0] == m and d[1] > 0]
        whole = of([("x", *r) for r in rows], "m string, " + T)
        types = of([("x", s, o) for s, p, o, _ in rows if p == "type"], "m string, node string, c string")
        ends = {}
        for _, p, o, k in rows:
            if k == "iri" and p != "type":
                ends[o] = ends.get(o, 0) + 1
        incoming = of([("x", o, n) for o, n in ends.items()], "m string, node string, n long")
        want = {r.check: r["count"] for r in mu.bad_nodes(whole, types, incoming, schema).groupBy("check").count().collect()}
        assert {c: found[m, c][1] for c in mu.CHECKS} == {c: want.get(c, 0) for c in mu.CHECKS}
    assert {r.name for r in mu.audit(matrix).collect() if r.kind == "dead_check"} == {c for c in mu.CHECKS if all(found[m, c][1] <= found[m, c][0] for m in ("lost", "moved", "typed", "words", "same"))} and found["lost", "dangling"] == (0, 1) and found["moved", "self_link"] == (0, 1)
    assert mu.sensitivity(of(FACTS, T), of(DELTAS, "m string, sign int, " + T).where("false"), schema).collect() == []


def test_checks_of_many_names_are_two_joins(spark):
    of = lambda rows, columns: spark.createDataFrame(rows, columns)
    wide = [(f"p{k}", f"C{k}") for k in range(70)]  # more names than a long has bits
    none = of([("", "")], "p string, c string").limit(0)
    schema = {
        "domain": of(wide, "p string, c string"), "range": of([(p, "R" + c) for p, c in wide], "p string, c string"), "required": of([("C69", "p68")], "c string, p string"), "disjoint": of([("C0", "C69")], "a string, b string"),
        "referenced": of([("C64",)], "c string"), "object_property": of([(p,) for p, _ in wide], "p string"), **{k: none.select("p") for k in ("data_property", "functional", "number")},
    }
    facts = [("a", "type", "C69", "iri"), ("a", "p69", "e", "iri"), ("b", "type", "C0", "iri"), ("b", "type", "C69", "iri"), ("b", "p68", "a", "iri"), ("d", "type", "C64", "iri"), ("d", "p64", "e", "iri"), ("e", "type", "RC64", "iri"), ("f", "type", "C64", "iri"), ("a", "p0", "f", "iri")]
    t = of([("x", *f) for f in facts], "m string, " + T)
    types = of([("x", s, o) for s, p, o, _ in facts if p == "type"], "m string, node string, c string")
    incoming = of([("x", o, 1) for o in ("a", "e", "f")], "m string, node string, n long")
    bad = mu.bad_nodes(t, types, incoming, schema)
    # a: p0 needs C0 and p68 is absent, f and e are not of the ranges; b: both classes, p68 needs C68, and a is no RC68; nothing leads to d
    assert sorted((r.check, r.node) for r in bad.collect()) == [("disjoint", "b"), ("domain", "a"), ("domain", "b"), ("missing", "a"), ("range", "a"), ("range", "b"), ("unreferenced", "d")]
    assert bad._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2
