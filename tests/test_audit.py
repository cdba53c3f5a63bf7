"""Audits against brute force and hand-built cases."""

import random
from collections import defaultdict, deque

import pytest

from graphloom.operators import audit as au
from graphloom.operators import reasoning as rs
from graphloom.plans import star_graph as sg
from graphloom.queries import QUERIES
from graphloom.sources.tables import inline


def shares(edges, sources):
    """Betweenness by counting shortest paths from each source."""
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    found = dict.fromkeys(near, 0.0)
    for source in sources:
        d, ways, order, queue = {source: 0}, defaultdict(float, {source: 1.0}), [], deque([source])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in d:
                    d[w] = d[v] + 1
                    queue.append(w)
                if d[w] == d[v] + 1:
                    ways[w] += ways[v]
        part = defaultdict(float)
        for w in reversed(order):
            for v in near[w]:
                if d[v] == d[w] - 1:
                    part[v] += ways[v] / ways[w] * (1 + part[w])
            if w != source:
                found[w] += part[w]
    n = len(near)
    return {v: x * n / (len(sources) * (n - 1) * (n - 2)) for v, x in found.items()}


def test_betweenness_counts_every_shortest_path(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("e", "f"), ("f", "c"), ("f", "g"), ("x", "y"), ("g", "g"), ("b", "a")]
    for sources in (list("abcdefgxy"), ["a", "f"]):
        got = au.betweenness(inline(spark, edges, "a string, b string"), inline(spark, [(s,) for s in sources], "node string")).collect()
        assert {r.node: pytest.approx(r.betweenness) for r in got} == shares(edges, sources)
    assert au.betweenness(inline(spark, [], "a string, b string"), inline(spark, [], "node string")).count() == 0


def test_betweenness_folds_trees_that_hang_by_one_edge(spark, monkeypatch):
    walked = []
    real = au.distances
    monkeypatch.setattr(au, "distances", lambda edges, sources: walked.append(edges.count()) or real(edges, sources))
    # a ring with trees of depth 5 and 1, of which one holds a source; and a pair of its own
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "h1"), ("h1", "h2"), ("h2", "h3"), ("h3", "h4"), ("h4", "h5"), ("h2", "i"), *[("c", f"k{x}") for x in range(5)], ("x", "y"), ("k1", "l1"), ("k1", "l2")]
    for sources in (["a", "l1"], ["y", "k0", "h4"]):
        got = au.betweenness(inline(spark, edges, "a string, b string"), inline(spark, [(s,) for s in sources], "node string")).collect()
        assert {r.node: pytest.approx(r.betweenness) for r in got} == shares(edges, sources)
    assert walked[0] == 16  # both ways: the ring, two edges to the source, two that three rounds leave of the long tree; the pair folds


def test_exact_betweenness_takes_every_node_as_a_source(spark, monkeypatch):
    rng = random.Random(5)
    ring = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "h1"), ("h1", "h2"), ("h2", "h3"), ("h2", "i"), *[("c", f"k{x}") for x in range(4)], ("k1", "l1"), ("x", "y"), ("g", "g"), ("b", "a")]
    forest = [("o1", "c1"), ("o2", "c1"), ("o3", "c2"), ("c1", "n1"), ("c2", "n1"), ("n1", "r"), ("n2", "r"), ("o4", "c9")]
    mixed = [(f"v{rng.randrange(14)}", f"v{rng.randrange(14)}") for _ in range(17)] + [(f"v{rng.randrange(14)}", f"t{x}") for x in range(5)]
    for edges, rows in ((ring + forest, 10**6), (mixed, 100)):  # in one batch of sources, and in several
        monkeypatch.setattr(au, "BATCH_ROWS", rows)
        got = {r.node: r.betweenness for r in au.exact_betweenness(inline(spark, edges, "a string, b string")).collect()}
        assert got == {v: pytest.approx(x) for v, x in shares(edges, sorted({v for e in edges for v in e if e[0] != e[1]})).items()}
    assert au.exact_betweenness(inline(spark, [], "a string, b string")).count() == 0


def test_the_query_of_betweenness_leaves_no_source_out(spark, monkeypatch):
    monkeypatch.setattr(au, "distances", None)  # the tables' graph is a forest: folding does it all
    edges = [(r.s, r.o) for r in sg.graph(spark, "/root/testdata/sf0.001").where("o_kind = 'iri' and p <> 'type'").select("s", "o").collect()]
    got = {r.node: r.betweenness for r in QUERIES["betweenness"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {v: pytest.approx(x, abs=1e-9) for v, x in shares(edges, sorted({v for e in edges for v in e})).items()}


def test_inverses_fit_by_both_sides(spark):
    properties = [("p", "A", "B"), ("q", "B", "A"), ("low", "C", "A"), ("off", "D", "A"), ("any", "Thing", "A"), ("half", None, "A"), ("bare", None, None), ("bare2", None, None)]
    pairs = [("p", "q"), ("p", "low"), ("p", "off"), ("p", "any"), ("p", "half"), ("bare", "bare2"), ("unknown", "q")]
    found = au.fitting_inverses(inline(spark, pairs, "p string, q string"), inline(spark, properties, "p string, domain string, range string"), inline(spark, [("C", "B")], "a string, b string"))
    assert {(r.p, r.q) for r in found.where("fits").collect()} == {("p", "q"), ("p", "low"), ("p", "any"), ("bare", "bare2")}
    assert found.count() == len(pairs)


def test_restrictions_and_shapes(spark):
    columns = "c string, p string, low int, high int"
    schema = inline(spark, [("A", "p", 1, None), ("A", "q", 1, 2)], columns)
    assert au.cardinality_sync(schema, inline(spark, [], columns)).count() == 0
    found = au.cardinality_sync(schema, inline(spark, [("A", "p", 1, None), ("A", "q", 1, 1), ("B", "p", 0, 1)], columns)).collect()
    assert {(r.c, r.p): r.status for r in found} == {("A", "p"): "same", ("A", "q"): "differs", ("B", "p"): "only_shapes"}


def test_checks_that_never_fire(spark):
    trials = [(m, "M1", c, c == "good" and m < 9, True, c != "broken") for m in range(10) for c in ("good", "idle", "broken", "syntax", "told")] + [(99, "M2", "rare", False, True, True)]
    df = inline(spark, trials, "mutant long, category string, check string, caught boolean, adds boolean, healthy boolean")
    reach = inline(spark, [("M1", c) for c in ("good", "idle", "broken")] + [("M2", "rare")], "category string, check string")
    dead = au.dead_checks(df, inline(spark, [("told",)], "check string"), reach, ["syntax"]).collect()
    assert {r.check: r.verdict for r in dead} == {"idle": "consider_removal", "broken": "structurally_undetectable", "syntax": "no_probe_available", "rare": "insufficient_exposure"}
    assert {r.category: (r.n_mutants, r.n_caught) for r in au.blind_spots(df).collect()} == {"M1": (10, 9), "M2": (1, 0)}


def test_links_that_lead_nowhere(spark):
    columns = "s string, p string, o string, o_kind string"
    declared = [("own:o", "imports", "far:", "iri"), ("own:a", "subClassOf", "far:b", "iri"), ("own:a", "label", "far:b", "lit")]
    one = au.interlinking(inline(spark, declared, columns), "own:", ["far:"]).first()
    assert (one.n_imports, one.n_referenced, one.n_resolved, one.inert, one.score, one.passed) == (1, 1, 0, True, 70, True)
    one = au.interlinking(inline(spark, [*declared, ("far:b", "label", "b", "lit")], columns), "own:", ["far:"]).first()
    assert (one.n_resolved, one.inert, one.score) == (1, False, 100)
    one = au.interlinking(inline(spark, [], columns), "own:", ["far:"]).first()
    assert (one.n_imports, one.external_pct, one.score, one.passed) == (0, 0.0, 0, False)


def test_rules_conclude_for_their_own_properties_only(spark):
    """Triples of properties that no rule reads or concludes stay as they are, repeated ones once."""
    t = inline(spark, [("x", "p", "y", "iri"), ("x", "p", "y", "iri"), ("x", "other", "z", "lit"), ("y", "q", "x", "iri")], "s string, p string, o string, o_kind string")
    schema = {"inverse": inline(spark, [("p", "q")], "p string, q string"), "domain": inline(spark, [("q", "C")], "p string, c string")}
    assert rs.concluded(schema) == ["p", "q", "type"]
    found = sorted((r.s, r.p, r.o) for r in rs.fixpoint(t, schema).collect())
    assert found == [("x", "other", "z"), ("x", "p", "y"), ("y", "q", "x"), ("y", "type", "C")]
