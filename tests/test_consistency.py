"""Minimal inconsistent sets of axioms against a search over all subsets."""

import random
from itertools import combinations

import pytest

from graphloom.operators import consistency as cs

AXIOM = "axiom string, kind string, a string, b string"
SPO = "s string, p string, o string, o_kind string, o_dt string"


def closed(facts, axioms):
    """Types, links and literals that follow, by trying all axioms until nothing is new."""
    facts = set(facts)
    while True:
        new = set()
        for _, kind, a, b in axioms:
            for s, p, o, k, dt in facts:
                if kind in ("subclass", "equivalent_class") and p == "type" and o == a:
                    new.add((s, "type", b, "iri", None))
                if kind == "equivalent_class" and p == "type" and o == b:
                    new.add((s, "type", a, "iri", None))
                if p == "type":
                    continue
                if kind == "subproperty" and p == a:
                    new.add((s, b, o, k, dt))
                if kind == "domain" and p == a:
                    new.add((s, "type", b, "iri", None))
                if k == "iri":
                    if kind == "range" and p == a:
                        new.add((o, "type", b, "iri", None))
                    if kind == "inverse" and p in (a, b):
                        new.add((o, b if p == a else a, s, "iri", None))
                        new |= {(o, a, s, "iri", None)} if a == b else set()
                    if kind == "symmetric" and p == a:
                        new.add((o, p, s, "iri", None))
        if new <= facts:
            return facts
        facts |= new


def inconsistent(facts, axioms):
    """The nodes that contradict the axioms."""
    all_ = closed(facts, axioms)
    types = {}
    for s, p, o, _, _ in all_:
        if p == "type":
            types.setdefault(s, set()).add(o)
    bad = {s for s, own in types.items() if "Nothing" in own}
    for _, kind, a, b in axioms:
        if kind == "disjoint":
            bad |= {s for s, own in types.items() if a in own and b in own}
        values = {}
        for s, p, o, k, dt in all_:
            if k == "lit" and p == a:
                values.setdefault(s, set()).add((o, dt))
                if kind == "datatype" and dt != b:
                    bad.add(s)
        if kind == "functional":
            bad |= {s for s, own in values.items() if len(own) > 1}
    return bad


def random_case(seed):
    rng = random.Random(seed)
    classes, props = ["A", "B", "C", "D", "Nothing"], ["p", "q", "r"]
    kinds = ["subclass"] * 4 + ["equivalent_class", "subproperty", "subproperty", "inverse", "symmetric", "domain", "domain", "range", "disjoint", "disjoint", "functional", "datatype"]
    axioms = []
    for k in range(10):
        kind = rng.choice(kinds)
        two = {"subclass": (classes[:4], classes), "equivalent_class": (classes[:4], classes[:4]), "disjoint": (classes[:4], classes[:4]), "domain": (props, classes[:4]), "range": (props, classes[:4]), "datatype": (props, ["int", "text"])}.get(kind, (props, props))
        axioms.append((f"x{k}", kind, rng.choice(two[0]), None if kind in ("functional", "symmetric") else rng.choice(two[1])))
    nodes = ["n1", "n2", "n3"]
    facts = [(rng.choice(nodes), rng.choice(props), rng.choice(nodes), "iri", None) for _ in range(3)]
    facts += [(rng.choice(nodes), rng.choice(props), rng.choice("12"), "lit", rng.choice(["int", "text", None])) for _ in range(4)]
    return axioms, facts + [(rng.choice(nodes), "type", rng.choice(classes[:4]), "iri", None) for _ in range(3)]


@pytest.mark.parametrize("seed", [1, 4])
def test_minimal_sets_are_those_of_a_search_over_all_subsets(spark, seed):
    axioms, facts = random_case(seed)
    t, ax = spark.createDataFrame(facts, SPO), spark.createDataFrame(axioms, AXIOM)
    least = []
    for size in range(len(axioms) + 1):
        for own in combinations(axioms, size):
            names = {a[0] for a in own}
            if not any(known <= names for known in least) and inconsistent(facts, own):
                least.append(names)
    found = cs.inconsistent_axioms(t, ax).collect()
    assert sorted(sorted(r.axioms) for r in found) == sorted(sorted(x) for x in least)
    for r in found:
        own = [a for a in axioms if a[0] in r.axioms]
        bad = inconsistent(facts, own)
        assert r.n == len(bad) and r.example == min(bad)


def test_classes_without_instances(spark):
    axioms = [("s1", "subclass", "A", "B"), ("s2", "subclass", "A", "C"), ("s3", "subclass", "B", "E"), ("d1", "disjoint", "C", "E"), ("d2", "disjoint", "B", "C"), ("e", "equivalent_class", "A", "F"), ("n", "subclass", "G", "Nothing"), ("x", "disjoint", "H", "H")]
    found = {(r["class"], tuple(r.axioms)) for r in cs.unsatisfiable_classes(spark.createDataFrame(axioms, AXIOM)).collect()}
    assert found == {("A", ("d1", "s1", "s2", "s3")), ("A", ("d2", "s1", "s2")), ("F", ("d1", "e", "s1", "s2", "s3")), ("F", ("d2", "e", "s1", "s2")), ("G", ("n",)), ("H", ("x",))}


def test_no_contradiction_and_no_rows(spark):
    axioms = spark.createDataFrame([("s1", "subclass", "A", "B"), ("f", "functional", "p", None), ("d", "disjoint", "B", "Z")], AXIOM)
    t = spark.createDataFrame([("n", "type", "A", "iri", None), ("n", "p", "1", "lit", "int"), ("n", "p", "m", "iri", None), ("m", "p", None, "lit", None)], SPO)
    assert cs.inconsistent_axioms(t, axioms).collect() == [] == cs.inconsistent_axioms(t.where("false"), axioms).collect()
    assert cs.clashes(t, axioms.where("false")).collect() == []
