"""Tiers of classes and justifications with premises."""

from pyspark.sql import functions as F

from graphloom import storage
from graphloom.operators import checks as ck
from graphloom.operators import reasoning as rs
from graphloom.operators import tiers as ti

SPO = "s string, p string, o string, o_kind string"


def test_tiers_and_what_they_allow(spark):
    t = [(f"m{k}", "type", "Machine", "iri") for k in range(4)] + [(f"r{k}", "type", "RunLog", "iri") for k in range(2)] + [("z", "type", "Zone", "iri")]
    t += [("r0", "on", "m0", "iri"), ("r0", "on", "gone", "iri"), ("r1", "on", "m1", "iri"), ("m0", "name", "x", "lit"), ("m1", "name", "y", "lit")]
    df = spark.createDataFrame(t, SPO)
    declared = spark.createDataFrame([("Machine",), ("RunLog",), ("Ghost",)], "c string")
    tiers = ti.class_tiers(df, declared, ["Zone"], most=3)
    assert {tuple(r) for r in tiers.collect()} == {("Machine", 4, "transaction"), ("RunLog", 2, "transaction"), ("Ghost", 0, "inferred"), ("Zone", 1, "catalog")}
    assert {r.c: r.tier for r in ti.class_tiers(df, declared).collect()} == {"Machine": "master", "RunLog": "transaction", "Ghost": "inferred", "Zone": "master"}
    domain, range_ = (spark.createDataFrame(rows, "p string, c string") for rows in ([("name", "Machine"), ("on", "RunLog")], [("on", "Machine")]))
    found = {(r.c, r.metric): (r.value, r.passed) for r in ti.tier_report(df, ti.class_tiers(df, declared), domain, range_).collect()}
    assert found == {("Machine", "orphan"): (0.5, True), ("RunLog", "orphan"): (1.0, True), ("Zone", "orphan"): (1.0, True), ("RunLog", "dangling"): (0.333333, False), ("Machine", "coverage"): (50.0, False), ("RunLog", "coverage"): (100.0, True)}


def test_a_task_holds_a_bounded_number_of_types(spark, monkeypatch):
    monkeypatch.setattr(storage, "ROWS_A_TASK", 100, raising=False)
    t = spark.range(2000).selectExpr("concat('s', id % 1000) as s", "'type' as p", "concat('C', id % 2) as o", "'iri' as o_kind")
    tasks = [r[1] for r in ti._types(t).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 1000 and max(tasks) < 150
    assert {tuple(r) for r in ti.class_tiers(t, t.select(F.col("o").alias("c"))).collect()} == {("C0", 500, "master"), ("C1", 500, "master")}


def test_justifications_tell_their_premises(spark):
    before = spark.createDataFrame([("a", "owns", "b", "iri"), ("b", "owns", "c", "iri"), ("x", "type", "Dog", "iri"), ("n", "near", "m", "iri"), ("b", "name", "B", "lit")], SPO)
    of = lambda rows, columns: spark.createDataFrame(rows, columns)
    schema = {"domain": of([("owns", "Owner")], "p string, c string"), "range": of([("owns", "Thing"), ("name", "Name")], "p string, c string"), "subclass": of([("Dog", "Animal")], "a string, b string"), "inverse": of([("owns", "ownedBy")], "p string, q string"), "symmetric": of([("near",)], "p string"), "transitive": of([("owns",)], "p string")}
    derived = [("a", "type", "Owner"), ("b", "type", "Thing"), ("x", "type", "Animal"), ("b", "ownedBy", "a"), ("m", "near", "n"), ("a", "owns", "c"), ("a", "owns", "b"), ("B", "type", "Name"), ("q", "type", "Q")]
    found = {(r.s, r.p, r.o): (r.rule, r.premises, r.confidence) for r in rs.justified(of(derived, "s string, p string, o string"), before, schema).collect()}
    assert found == {
        ("a", "type", "Owner"): ("domain", ["(a, owns, _) stated", "(owns, domain, Owner) in the schema"], "high"), ("b", "type", "Thing"): ("range", ["(_, owns, b) stated", "(owns, range, Thing) in the schema"], "high"),
        ("x", "type", "Animal"): ("subclass", ["(x, type, Dog) stated", "(Dog, subClassOf, Animal) in the schema"], "high"), ("b", "ownedBy", "a"): ("inverse", ["(a, owns, b) stated", "(ownedBy, inverseOf, owns) in the schema"], "high"),
        ("m", "near", "n"): ("symmetric", ["(n, near, m) stated", "(near, type, SymmetricProperty) in the schema"], "high"), ("a", "owns", "c"): ("transitive", ["(a, owns, b) stated", "(b, owns, c) stated", "(owns, type, TransitiveProperty) in the schema"], "high"),
        ("a", "owns", "b"): ("already_exists", [], "high"), ("B", "type", "Name"): ("unknown", [], "low"), ("q", "type", "Q"): ("unknown", [], "low"),
    }


def test_regressions_need_no_single_task(spark):
    runs = spark.createDataFrame([(k, 10 - (k % 7 == 3) - (k % 5 == 0), 10 + (k > 50)) for k in range(100)], "run long, passed long, total long").repartition(5)
    rows = [(k, 10 - (k % 7 == 3) - (k % 5 == 0), 10 + (k > 50)) for k in range(100)]
    want = [b[0] for a, b in zip(rows, rows[1:], strict=False) if (b[1] < a[1] if a[2] == b[2] else b[2] - b[1] > a[2] - a[1])]
    found = ck.run_regressions(runs)
    assert sorted(r.run for r in found.collect()) == want
