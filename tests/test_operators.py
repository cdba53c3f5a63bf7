"""Hand-built cases: edge values of coercion and keys, small graphs, checks that can fail, readers and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.functions import coercion as co
from graphloom.operators import analytics as an
from graphloom.operators import checks as ck
from graphloom.operators import graph as gr
from graphloom.operators import profile as pr
from graphloom.operators import reasoning as rs
from graphloom.sources import tables as st
from graphloom.streaming.incremental import drift_to, windowed_counts


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(("value", "want"), [("1_0", 10.0), ("1e3", 1000.0), (" 7 ", 7.0), ("1.5d", None), ("x", None), ("", None), (None, None), ("inf", float("inf"))])
def test_numbers(spark, value, want):
    assert one(spark, co.to_number, value) == want


@pytest.mark.parametrize(("value", "want"), [("127", 127), ("128", None), ("-128", -128), ("3.9", 3), ("-3.9", -3)])
def test_bytes(spark, value, want):
    assert one(spark, lambda c: co.to_integer(c, -128, 127), value) == want


@pytest.mark.parametrize(("value", "order", "want"), [("03/04/2025", None, None), ("03/04/2025", "dmy", (2025, 4, 3)), ("03/04/2025", "mdy", (2025, 3, 4)), ("12/25/2025", None, (2025, 12, 25)), ("25/12/2025", None, (2025, 12, 25)), ("2025-02-30", None, None), ("2025-01-02T03:04:05Z", None, (2025, 1, 2, 3, 4, 5)), ("03/04/2025", "odd", None)])
def test_dates(spark, value, order, want):
    assert one(spark, lambda c: co.to_timestamp(c, order), value) == (datetime.datetime(*want) if want else None)


@pytest.mark.parametrize("value", ["EQ-001", "eq_001", "EQ.001", " eq 001 ", "ＥＱ–001"])
def test_normal_keys(spark, value):
    assert one(spark, lambda c: co.normal_key(c, compatibility=True), value) == "eq001"


def test_names(spark):
    assert one(spark, co.safe_local, "a b/é") == "a_b_é" and one(spark, co.safe_iri, "a  b") == "a_b"
    assert [one(spark, co.local_name, x) for x in ("http://x/y#z", "http://x/y", "z")] == ["z", "y", "z"]
    assert one(spark, co.without_sentinel, " N/A ") is None and one(spark, lambda c: co.without_sentinel(c, True), "-") == "-"
    assert one(spark, co.to_boolean, "Yes") is True and one(spark, co.to_boolean, "maybe") is None


def test_ladder_does_not_misroute(spark):
    master = spark.createDataFrame([("EQ001",), ("EQ002",), ("EQ0013",)], "k string")
    values = spark.createDataFrame([("EQ001",), ("eq-002",), ("EQ0O1",), ("EQ", ), ("EQ00",), (None,), ("ZZ",)], "v string")
    got = {r.value: (r.match, r.stage) for r in pr.fk_ladder(values, "v", master, "k").collect()}
    assert got["EQ001"] == ("EQ001", 1) and got["eq-002"] == ("EQ002", 2) and got["EQ0O1"] == ("EQ001", 3)
    assert got["EQ00"][1] == 3 and got["EQ"] == (None, None) and got["ZZ"] == (None, None) and None not in got


def test_composite_key_takes_the_largest_name_on_ties(spark):
    df = spark.createDataFrame([(i % 3, i % 2, i % 2) for i in range(6)], "a int, b int, c int")
    assert pr.composite_key(df, ["a", "b", "c"]) == ["a", "c"]


def triples(spark, rows):
    return spark.createDataFrame([(s, p, o, "lit" if o[0].isdigit() else "iri", float(o) if o[0].isdigit() else None) for s, p, o in rows], "s string, p string, o string, o_kind string, o_num double")


def test_patterns(spark):
    t = triples(spark, [("a", "p", "a"), ("a", "p", "b"), ("b", "q", "c")])
    assert [r.x for r in gr.match(t, "?x", "p", "?x").collect()] == ["a"]
    with pytest.raises(ValueError):
        gr.join(gr.match(t, "?x", "p", "?y"), gr.match(t, "?u", "q", "?v"))
    assert gr.ask(gr.match(t, "a", "p", "?z")) and not gr.ask(gr.match(t, "c", "p", "?z"))


def test_closure_ends_on_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")], "a string, b string")
    assert gr.transitive(e).count() == 16


def test_components(spark):
    e = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("x", "y")], "a string, b string")
    got = {r.node: r.component for r in gr.components(e).collect()}
    assert set(got.values()) == {"n00", "x"} and got["n20"] == "n00"


def test_fixpoint_of_a_small_university(spark):
    t = triples(spark, [("ann", "type", "Professor"), ("ann", "worksFor", "lab"), ("lab", "subOrg", "dept"), ("dept", "subOrg", "uni"), ("uni", "alumnus", "bob")])
    schema = {
        "subclass": spark.createDataFrame([("Professor", "Faculty"), ("Faculty", "Person")], "a string, b string"),
        "transitive": spark.createDataFrame([("subOrg",)], "p string"),
        "inverse": spark.createDataFrame([("alumnus", "degreeFrom")], "p string, q string"),
        "range": spark.createDataFrame([("worksFor", "Organization")], "p string, c string"),
        "chain": spark.createDataFrame([("worksFor", "subOrg", "memberOf")], "p string, q string, r string"),
        "symmetric": spark.createDataFrame([("near",)], "p string"),
    }
    got = {(r.s, r.p, r.o) for r in rs.fixpoint(t, schema).collect()}
    assert {("ann", "type", "Person"), ("lab", "subOrg", "uni"), ("bob", "degreeFrom", "uni"), ("lab", "type", "Organization"), ("ann", "memberOf", "uni")} <= got
    assert ("uni", "subOrg", "lab") not in got and ("bob", "type", "Person") not in got


@pytest.mark.parametrize(("make", "good", "bad"), [
    (ck.fk_ref, [("a", "type", "C"), ("b", "type", "C"), ("a", "p", "b")], [("a", "type", "C"), ("a", "p", "b")]),
    (ck.orphan, [("a", "type", "C"), ("a", "p", "b")], [("a", "type", "C")]),
    (ck.dangling, [("a", "p", "b"), ("b", "type", "C")], [("a", "p", "b")]),
    (lambda t: ck.functional(t, ["p"]), [("a", "p", "b")], [("a", "p", "b"), ("a", "p", "c")]),
    (lambda t: ck.disjoint(t, [["C", "D"]]), [("a", "type", "C")], [("a", "type", "C"), ("a", "type", "D")]),
    (lambda t: ck.master_orphan(t, ["C"]), [("a", "type", "C"), ("b", "p", "a")], [("a", "type", "C"), ("a", "p", "b")]),
    (ck.numeric_outliers, [(str(i), "n", str(i % 5)) for i in range(20)], [(str(i), "n", str(i % 5)) for i in range(20)] + [("x", "n", "1000")]),
])
def test_checks_can_fail_and_pass(spark, make, good, bad):
    assert make(triples(spark, good)).first().n_bad == 0 and make(triples(spark, bad)).first().n_bad > 0


def test_check_on_nothing_is_not_applicable(spark):
    row = ck.fk_ref(triples(spark, [("a", "p", "b")]).limit(0)).first()
    assert (row.applicable, row.n_checked, row.n_bad) == (False, 0, 0)


def test_ntriples_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("http://x/a", "http://x/p", 'say "hi"\nnow', "lit"), ("http://x/a", "http://x/q", "http://x/b", "iri")], "s string, p string, o string, o_kind string")
    st.write_ntriples(t, str(tmp_path / "nt"))
    got = st.read_ntriples(spark, str(tmp_path / "nt")).select("s", "p", "o", "o_kind").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in t.collect()}


def test_csv_and_duplicate_files(spark, tmp_path):
    for name in ("b.csv", "a.csv"):
        (tmp_path / name).write_text("﻿id,v\n1,x\n")
    (tmp_path / "c.csv").write_text("id,v\n2,y\n")
    assert st.read_csv(spark, str(tmp_path / "a.csv")).columns == ["id", "v"]
    got = sorted(r.path.rsplit("/", 1)[1] for r in st.distinct_files(spark, str(tmp_path / "*.csv"), ["b.csv"]).collect())
    assert got == ["b.csv", "c.csv"]


def test_scores(spark):
    row = spark.range(1).select(an.timeliness(F.lit(30)).alias("a"), an.timeliness(F.lit(180)).alias("b"), an.amount_score(F.lit(1000)).alias("c"), an.chained_confidence(F.lit(5)).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (100.0, 0.0, 40.0, 0.3)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(datetime.datetime(2024, 1, 1), "u", "new"), (datetime.datetime(2024, 1, 2), "u", "old")], "ts timestamp_ntz, user_id string, v string").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = windowed_counts(stream, "ts", "user_id").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable(), q.stop()
    assert sum(r.n for r in spark.table("counts").collect()) == 2
    q = drift_to(stream, "v", spark.createDataFrame([("old",)], "value string"), str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable(), q.stop()
    assert [r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["new"]


def test_dimensions_of_small_and_empty_graphs(spark):
    from graphloom.operators import dimensions as dm

    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(6)] + [("x", "x")], "a string, b string")
    got = dm.approximate_diameter(chain, 100).first()
    assert (got.sampled_sources, got.approx_diameter) == (8, 6)
    assert dm.approximate_diameter(chain.limit(0)).first().sampled_sources == 0
    rows = [("http://a/x#1", "http://a/p", "v", "lit", "string"), ("http://a/x#2", "http://a/p", "1", "lit", "decimal"), ("http://b/y", "http://a/q", "http://c/z", "iri", None)]
    full = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_dt string")
    assert dm.representation(full).first().score == 50.0  # four namespaces, the one literal property is mixed
    none = full.limit(0)
    assert (dm.amount(none).first().score, dm.representation(none).first().score) == (0.0, 75.0)
    said = spark.createDataFrame([(1.0, "a"), (0.5, "b")], "confidence double, source string")
    assert (dm.trust(said).first().score, dm.trust(said.limit(0)).first().score) == (60.0, 0.0)
    terms = spark.createDataFrame([("t",), ("u",)], "term string")
    labels = spark.createDataFrame([("t", "en"), ("t", "ko"), ("u", None)], "term string, lang string")
    assert tuple(dm.understandability(terms, labels, terms.where("term = 't'")).first()) == (100.0, 50.0, 50.0, 70.0)


def test_cells_are_traced_back(spark):
    from graphloom.operators import dimensions as dm

    df = spark.createDataFrame([(1, "a", None), (2, None, "b")], "k int, x string, y string")
    made = dm.cell_provenance(df, "tab", F.concat(F.lit("I_"), F.col("k").cast("string")), "k", {"p": "x", "q": "y"})
    assert made.count() == 2 * (4 + 2 * 6)
    got = sorted(map(tuple, dm.traced_cells(made).collect()))
    assert got == [(f"I_{k}", "tab", k, p, c) for k in (1, 2) for p, c in (("p", "x"), ("q", "y"))]


@pytest.mark.parametrize("value", ["n/a", "NA", "null", "-", "None", "#N/A", "nan", "Undefined", "미정", "해당없음", "", " "])
def test_missing_words(spark, value):
    assert one(spark, co.without_sentinel, value) is None
    assert one(spark, co.without_sentinel, "없음") == "없음"


@pytest.mark.parametrize(("value", "want"), [
    ("2024-01-02 03:04:05.123", (2024, 1, 2, 3, 4, 5, 123000)), ("2024-01-02T03:04:05.5", (2024, 1, 2, 3, 4, 5, 500000)), ("2024.01.02 03:04:05", (2024, 1, 2, 3, 4, 5)), ("20240102030405", (2024, 1, 2, 3, 4, 5)),
    ("2024/01/02 03:04:05.1", (2024, 1, 2, 3, 4, 5, 100000)), ("2024.01.02 03:04:05.25", (2024, 1, 2, 3, 4, 5, 250000)), ("20240102", (2024, 1, 2)), ("2024-01-02 03:04", (2024, 1, 2, 3, 4)), ("2024/1/2", (2024, 1, 2)),
    ("2024-01-02T03:04:05+09:00", (2024, 1, 1, 18, 4, 5)), ("25.12.2024", (2024, 12, 25)), ("12-25-2024", (2024, 12, 25)), ("03-04-2024", None), ("03.04.2024", None), ("25/12-2024", None), ("31.02.2024", None), ("2024-13-01", None), ("x", None),
])
def test_date_forms(spark, value, want):
    assert one(spark, co.to_timestamp, value) == (datetime.datetime(*want) if want else None)


def test_dates_of_a_stated_order(spark):
    got = [[one(spark, lambda c, o=order: co.to_timestamp(c, o), v) for v in ("03-04-2024", "25.12.2024", "12/25/2024")] for order in ("dmy", "mdy")]
    d = datetime.datetime
    assert got == [[d(2024, 4, 3), d(2024, 12, 25), None], [d(2024, 3, 4), None, d(2024, 12, 25)]]


def test_dash_columns_and_values(spark):
    df = spark.createDataFrame([("-", "-"), ("+", "a"), ("", "b"), (None, "c"), ("0", "d"), ("-", "e")], "sign string, name string")
    assert {r["column"]: (r.n_distinct, r.keeps_dash) for r in co.dash_columns(df, df.columns).collect()} == {"sign": (3, True), "name": (6, False)}
    assert one(spark, co.normal_value, "﻿ a   b ") == "a b"
    got = co.canonical(spark.createDataFrame([(" a  b ",), ("z",), (None,)], "v string"), "v", spark.createDataFrame([("a b", "AB")], "alias string, canon string"))
    assert sorted((r.value or "", r.unknown) for r in got.collect()) == [("", False), ("AB", False), ("z", True)]


def test_quantiles_and_upper_median(spark):
    import statistics

    import numpy as np

    from graphloom.operators import quantiles as qu

    groups = {"a": [3.0, 1.0, 2.0, 10.0], "b": [5.0], "c": [float(i % 7) for i in range(50)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None, float("nan")]], "g string, v double").repartition(5)
    rows = qu.cumulated(df, "g", "v").groupBy("g").agg(*[qu.quantile("v", p).alias(f"q{int(p * 100)}") for p in (0.1, 0.25, 0.5, 0.9)], qu.upper_median("v").alias("up")).collect()
    assert len(rows) == 3
    for r in rows:
        vs = sorted(groups[r.g])
        assert [r.q10, r.q25, r.q50, r.q90] == pytest.approx(np.quantile(vs, [0.1, 0.25, 0.5, 0.9]).tolist()) and r.up == vs[len(vs) // 2] and r.q50 == statistics.median(vs)


def test_checks_near_their_thresholds(spark):
    numbers = lambda far: triples(spark, [(f"s{i}", "n", str(i % 5)) for i in range(100 - far)] + [(f"x{i}", "n", "1000") for i in range(far)])
    assert [(r.n_bad, r.passed) for r in (ck.numeric_outliers(numbers(k)).first() for k in (1, 5, 6))] == [(1, True), (5, True), (6, False)]
    hubs = lambda far: triples(spark, [(f"s{i}", "p", f"o{i}") for i in range(100 - far)] + [(f"h{i}", "p", f"x{k}") for i in range(far) for k in range(9)])
    assert [(r.n_bad, r.passed) for r in (ck.relationship_outliers(hubs(k)).first() for k in (5, 6))] == [(5, True), (6, False)]
    flow = [("a", "type", "Step"), ("b", "type", "Step"), ("a", "then", "b")]
    rows = [ck.process_flow(triples(spark, f), "then", "Step").first() for f in (flow, flow[:2], flow[1:], [("x", "q", "y")])]
    assert [(r.applicable, r.passed) for r in rows] == [(True, True), (True, False), (True, False), (False, True)]
    assert {(r.node, r.place) for r in ck.flow_ends(triples(spark, [*flow, ("b", "then", "c")]), "then").collect()} == {("a", "start"), ("c", "end")}
    limits = spark.createDataFrame([("weight", 0.0, 5.0)], "p string, low double, high double")
    rows = [ck.value_ranges(triples(spark, [("a", p, "7")]), limits).first() for p in ("netWeight", "height")]
    assert [(r.n_checked, r.n_bad, r.passed) for r in rows] == [(1, 1, False), (1, 1, False)] and ck.value_ranges(triples(spark, [("a", "netWeight", "3")]), limits).first().passed
    keys = spark.createDataFrame([("A", f"B{i}") for i in range(20)] + [("A", "A")], "domain string, range string")
    assert [ck.fk_op(keys, keys.where(f"range not in ('x'{out})")).first().passed for out in ("", ", 'B1', 'B2', 'B3'", ", 'B1', 'B2', 'B3', 'B4'")] == [True, True, False]
    due = spark.createDataFrame([("Gone", "p", 0.5)], "c string, p string, least double")
    assert [(r.n_checked, r.passed) for r in (ck.prop_completeness(triples(spark, flow), due, excluded=x).first() for x in (None, ["Gone"]))] == [(1, False), (0, True)]
    text = triples(spark, [("a", "x", "None"), ("b", "x", "fine"), ("c", "sign", "-")]).withColumns({"o_kind": F.lit("lit")})
    assert [ck.string_patterns(text, d).first().n_bad for d in (None, ["sign"])] == [2, 1]
    odd = spark.createDataFrame([("a", False, 0, 3, False), ("b", True, 5, 0, True)], "check string, applicable boolean, n_checked long, n_bad long, passed boolean")
    row = ck.scored(odd).first()
    assert (row.passed, row.total, row.score, row.measured_score, row.unreliable) == (2, 2, 100.0, 100.0, True)


def test_escapes_and_kinds_of_ntriples(spark, tmp_path):
    rows = [
        ("http://x/a", "http://x/p", "a\\nb", "lit", None, None), ("http://x/a", "http://x/p", 'q"\t\r\n\\', "lit", None, None), ("_:b1", "http://x/p", "5", "lit", "http://x/int", None),
        ("_:b1", "http://x/q", "_:b2", "bnode", None, None), ("http://x/a", "http://x/p", "été", "lit", None, "fr"),
    ]
    t = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_dt string, o_lang string")
    st.write_ntriples(t, str(tmp_path / "nt"))
    assert {tuple(r) for r in st.read_ntriples(spark, str(tmp_path / "nt")).collect()} == set(rows)
    (tmp_path / "u.nt").write_text('<http://x/\\u00e9> <http://x/p> "\\u00e9\\U0001F642\\\\u00e9 \\\\n" .\n# comment\nbroken\n')
    assert [tuple(r)[:3] for r in st.read_ntriples(spark, str(tmp_path / "u.nt")).collect()] == [("http://x/é", "http://x/p", "é🙂\\u00e9 \\n")]


def test_paths_unbound_joins_and_graphs(spark):
    t = triples(spark, [("a", "p", "b"), ("b", "p", "c"), ("x", "q", "b")])
    pairs = lambda df: {(r.a, r.b) for r in df.collect()}
    nodes = spark.createDataFrame([(n,) for n in "abcx"], "node string")
    assert pairs(gr.star_path(gr.step(t, "p"), nodes)) == {("a", "b"), ("b", "c"), ("a", "c")} | {(n, n) for n in "abcx"}
    assert pairs(gr.sequence_path(gr.step(t, "p"), gr.inverse_path(gr.step(t, "p", "q")))) == {("a", "a"), ("a", "x"), ("b", "b")}
    assert gr.transitive(spark.createDataFrame([], "a string, b string")).count() == 0
    left = spark.createDataFrame([("a", None), ("b", "1"), ("c", "2")], "x string, y string")
    right = spark.createDataFrame([("a", "7", "u"), ("b", "2", "v"), ("c", None, "w")], "x string, y string, z string")
    assert {tuple(r) for r in gr.compatible_join(left, right, ["y"]).select("x", "y", "z").collect()} == {("a", "7", "u"), ("c", "2", "w")}
    with pytest.raises(ValueError, match="would meet all"):
        gr.compatible_join(left.select("y"), right.select("y", "z"), ["y"])
    asked = gr.values(left.where("y is not null"), ["x", "y"], [("b", None), (None, "2")])
    assert {tuple(r) for r in asked.select("x", "y").collect()} == {("b", "1"), ("c", "2")}


def test_components_of_the_whole_graph_like_union_find(spark):
    from graphloom.plans import star_graph as sg
    from graphloom.queries import QUERIES

    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in sg.graph(spark, "/root/testdata/sf0.001").where("o_kind = 'iri' and p <> 'type'").collect():
        a, b = sorted((find(r.s), find(r.o)))
        root[b] = a
    assert {r.node: r.component for r in QUERIES["components"](spark, "/root/testdata/sf0.001").collect()} == {x: find(x) for x in list(root)}


def test_predicates_prune_tables(spark):
    from graphloom.plans import star_graph as sg

    df = gr.match(sg.graph(spark, "/root/testdata/sf0.001"), "?x", "nationName", "?n")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan


def test_keys_and_foreign_keys(spark):
    from graphloom.operators import ingest as ig

    assert ig.explicit_key(["ID", "b"], ["id", "B"]) == ["ID", "b"] and ig.explicit_key(["id"], ["id", "x"]) is None
    assert ig.key_candidates(["created_object_id", "plant_code", "ItemId", "note"], "ItemMaster") == ["ItemId", "plant_code", "created_object_id"]
    df = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("b", "2", " ")], "item_code string, lot_id string, note string")
    assert ig.detected_key(df, "Thing") == "item_code" and ig.detected_key(df.select("note"), "Thing") is None
    got = df.select(ig.row_key(["item_code", "note"], time="lot_id").alias("k"), ig.row_key(["item_code", "lot_id"], True, "note").alias("a")).collect()
    assert [tuple(r) for r in got] == [("a_x_1", "a_1"), ("b_x_1", "b_1"), (None, "b_2")]
    ends = {"_code": "{base}Master", "id": "{base}"}
    assert [ig.fk_class(c, {"origin_warehouse": "Warehouse"}, ends) for c in ("Origin_Warehouse", "plant_line_code", "work-orderid", "note", "lot_id")] == ["Warehouse", "PlantLineMaster", "Work-order", None, "Lot"]
    assert ig.is_fk("origin_warehouse", {"origin_warehouse": "W"}) and ig.is_fk("lotId", {}) and not ig.is_fk("note", {})
    props = spark.createDataFrame([("hasPlace", None, "Place"), ("fromPlace", "Trip", "Place"), ("toPlace", "Trip", "Place"), ("endsAt", "Move", "Site")], "p string, domain string, range string")
    sub = spark.createDataFrame([("Trip", "Move"), ("Site", "Place")], "a string, b string")
    choose = lambda column, **k: ig.fk_property("Trip", "Site", column, props, sub, **k)
    assert [choose("origin_site"), choose("destination_site"), choose("site"), choose("site", restricted=["endsAt"])] == ["fromPlace", "toPlace", "fromPlace", "endsAt"]
    assert ig.fk_property("Part", "Ghost", "x", props, sub) is None
    assert one(spark, lambda c: ig.fk_value(c, 2), "AB12") == "AB" and one(spark, lambda c: ig.fk_value(c, 2), "A") == "A"
    columns = spark.createDataFrame([("Trip", "start_day"), ("Trip", "fee"), ("Site", "fee")], "c string, column string")
    known = spark.createDataFrame([("day", "Move", "START-DAY"), ("fee", None, None), ("siteFee", "Site", "fee")], "p string, domain string, source string")
    assert {tuple(r) for r in ig.mapped_properties(columns, known, sub).collect()} == {("Trip", "start_day", "day", 3), ("Trip", "fee", "fee", 4), ("Site", "fee", "siteFee", 1)}
    assert [tuple(r) for r in ig.injected_properties(columns, columns.where("column = 'fee'")).collect()] == [("tripStartDay", "Trip", "start_day")]


def test_chains_constraints_and_profiles(spark):
    from graphloom.operators import evaluation as ev
    from graphloom.operators import governance as gv

    rules = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "a"), ("c", "d"), ("x", "y")], "cause string, effect string")
    assert {tuple(r) for r in ev.causal_chains(rules, "a").collect()} == {("a(change)>b", False), ("a(change)>b>c", False), ("a(change)>b>c>d", False), ("a(change)>b>a", True)} and ev.causal_chains(rules, "q").count() == 0
    meta = spark.createDataFrame([("Person", "+R", "+U", "+I"), ("Student", "-R", "+U", "-I")], "c string, rigidity string, unity string, identity string")
    sub = spark.createDataFrame([("Person", "Student"), ("Student", "Person")], "a string, b string")
    assert {tuple(r) for r in gv.ontoclean(meta, sub).collect()} == {("C1_rigidity", "Person", "Student"), ("C3_identity", "Person", "Student")}
    kinds = spark.createDataFrame([("subclass",), ("inverse",), ("chain",)], "kind string")
    assert {r.profile: (r.fits, r.n_outside) for r in gv.language_profiles(kinds).collect()} == {"EL": (False, 1), "QL": (False, 1), "RL": (True, 0)}
    with pytest.raises(ValueError, match="origin"):
        gv.tagged_origin(kinds, "rumour")
    assert ev.link_pattern("Order", [("Order", "placedBy", "Customer"), ("Customer", "inNation", "Nation")])[1:] == [("?x0", "placedBy", "?x1"), ("?x1", "type", "Customer"), ("?x1", "inNation", "?x2"), ("?x2", "type", "Nation")]


def test_equality_meets_rules(spark):
    t = triples(spark, [("a", "mail", "m"), ("b", "mail", "m"), ("a", "type", "C"), ("b", "near", "z"), ("q", "sameAs", "z"), ("c1", "type", "K"), ("c2", "type", "K"), ("c1", "no", "n1"), ("c2", "no", "n1")])
    got = {(r.s, r.p, r.o) for r in rs.closure(t, {"symmetric": spark.createDataFrame([("near",)], "p string")}, inverse_functional=["mail"], keys={"K": ["no"]}).collect()}
    assert got == {("a", "mail", "m"), ("a", "type", "C"), ("a", "near", "q"), ("q", "near", "a"), ("c1", "type", "K"), ("c1", "no", "n1")}


def test_last_values_and_labels(spark):
    t = spark.createDataFrame([("x", "type", "C", 1), ("x", "v", "9", 1), ("x", "v", "2", 2)], "s string, p string, o string, at int")
    assert an.pivoted(t, "C", ["v"], "at").first().v == "2" and an.pivoted(t, "C", ["v"]).first().v == "9"
    types = spark.createDataFrame([("n", "Customer"), ("n", "Party"), ("m", "A"), ("m", "B")], "uri string, label string")
    sub = spark.createDataFrame([("Customer", "Party"), ("A", "B"), ("B", "A")], "a string, b string")
    assert {tuple(r) for r in an.most_specific(types, sub).collect()} == {("n", "Customer"), ("m", "A"), ("m", "B")}
