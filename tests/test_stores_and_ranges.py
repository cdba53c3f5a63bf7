"""Readers, the stored graph, range joins, connectivity, alerts, chains, row keys and digests against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import coercion as co
from graphloom.operators import analytics as an
from graphloom.operators import evaluation as ev
from graphloom.operators import ingest as ig
from graphloom.operators import ranges as rg
from graphloom.plans import graph_store as gs
from graphloom.sources import tables as st
from graphloom.storage import stored

SPO = "s string, p string, o string, o_kind string"


def test_csv_cells_with_quotes_commas_and_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,"no, te"\n1,"a ""b"" c"\n2,"line one\nline two"\n3,"x,y"\n4,back\\slash\n5,\n')
    rows = [tuple(r) for r in st.read_csv(spark, str(tmp_path / "a.csv")).collect()]
    assert rows == [("1", 'a "b" c'), ("2", "line one\nline two"), ("3", "x,y"), ("4", "back\\slash"), ("5", None)]
    assert st.read_csv(spark, str(tmp_path / "a.csv")).columns == ["id", "no, te"]
    (tmp_path / "b.csv").write_text('id,v\n1,"a ""b"""\n')
    assert [tuple(r) for r in st.read_csv(spark, str(tmp_path / "b.csv"), lines_in_cells=False).collect()] == [("1", 'a "b"')]


def test_ntriples_lines_in_all_their_forms(spark, tmp_path):
    lines = ['<a> <p> "x" . # comment', "<a><p><b>.", '  <a>\t<p>\t"y"@en-GB .  ', "_:b1 <p> _:b.2 .", '_:b1<p>"1"^^<int>.#c', "# only a comment", "", "<a> <p> .", '<a> <p> "open .', "<a> <p> <b> . trailing"]
    (tmp_path / "x.nt").write_text("\n".join(lines))
    found = {tuple(r) for r in st.read_ntriples(spark, str(tmp_path)).collect()}
    assert found == {("a", "p", "x", "lit", None, None), ("a", "p", "b", "iri", None, None), ("a", "p", "y", "lit", None, "en-GB"), ("_:b1", "p", "_:b.2", "bnode", None, None), ("_:b1", "p", "1", "lit", "int", None)}
    bad = st.malformed_ntriples(spark, str(tmp_path)).collect()
    assert {r.value for r in bad} == set(lines[-3:]) and all(r.path.endswith("x.nt") for r in bad)


def test_offsets_count_and_z_is_utc(spark):
    values = ["2024-01-02T03:04:05+09:00", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05", "2024-12-31T23:30:00-01:30", "2024-01-02", "no"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(co.to_timestamp(F.col("v")).cast("string").alias("t")).collect()
    assert [r.t for r in got] == ["2024-01-01 18:04:05", "2024-01-02 03:04:05", "2024-01-02 03:04:05", "2025-01-01 01:00:00", "2024-01-02 00:00:00", None]


def test_a_pair_declared_both_ways_keeps_one_direction(spark):
    t = spark.createDataFrame([("a", "owns", "b", "iri"), ("b", "ownedBy", "a", "iri"), ("c", "ownedBy", "d", "iri"), ("a", "near", "b", "iri"), ("a", "near", "a", "iri")], SPO)
    for rows in ([("owns", "ownedBy")], [("owns", "ownedBy"), ("ownedBy", "owns"), ("near", "near")]):
        inverse = spark.createDataFrame(rows, "p string, q string")
        assert {tuple(r) for r in an.lpg_rels(t, inverse).collect()} == {("b", "a", "ownedBy"), ("c", "d", "ownedBy"), ("a", "b", "near")}
        assert {tuple(r) for r in an.lpg_rels(t, inverse, ["owns"]).collect()} == {("a", "b", "owns"), ("d", "c", "owns"), ("a", "b", "near")}


def test_a_digest_tells_terms_apart(spark):
    base = [("a", "p", "b", "iri")]
    others = [[("a", "p", "b", "lit")], [("a|p", "", "b", "iri")], [("a", "p|b", "", "iri")], [("a", "p", "c", "iri")], []]
    digest = lambda rows: an.graph_hash(spark.createDataFrame(rows, SPO)).first().digest
    assert len({digest(rows) for rows in [base, *others]}) == 6 and digest(base) == digest(base + base)
    typed = lambda dt, lang: an.graph_hash(spark.createDataFrame([("a", "p", "1", "lit", dt, lang)], SPO + ", o_dt string, o_lang string")).first().digest
    assert len({typed(None, None), typed("int", None), typed(None, "en")}) == 3


def test_an_empty_predicate_survives_storing(spark):
    rows = [("a", "", "b", "iri"), ("a", "p", "b", "iri"), ("a", None, "b", "iri")]
    kept = stored(spark.createDataFrame(rows, SPO), "odd", "p")
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, rows)) and kept.where("p = ''").count() == 1


# --- the stored graph ---------------------------------------------------------------------------------------------------------------


def test_a_stored_graph_is_reused_and_only_changed_tables_are_converted(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("one", "two")}
    for n, p in paths.items():
        spark.range(5).select(F.concat(F.lit(n), F.col("id").cast("string")).alias("s"), F.lit("p").alias("p"), F.lit("x").alias("o")).write.parquet(p)
    reads = []

    def convert(spark, path):
        reads.append(path)
        return spark.read.parquet(path)

    tables = {p: (convert, "as it stands") for p in paths.values()}
    first, written = gs.load(spark, tables)
    assert written == list(paths.values()) == reads and first.count() == 10
    again, written = gs.load(spark, tables)
    assert written == [] and len(reads) == 2 and {tuple(r) for r in again.collect()} == {tuple(r) for r in first.collect()}
    spark.range(1).select(F.lit("new").alias("s"), F.lit("q").alias("p"), F.lit("y").alias("o")).write.mode("append").parquet(paths["two"])
    changed, written = gs.load(spark, tables)
    assert written == [paths["two"]] and changed.count() == 11 and changed.where("p = 'q'").count() == 1
    _, written = gs.load(spark, {paths["one"]: (convert, "another mapping")})
    assert written == [paths["one"]]
    assert changed.where("p = 'q'")._jdf.queryExecution().toString().count("PushedFilters: [IsNotNull(p), EqualTo(p,q)]") >= 2
    gs.forget(spark)
    assert gs.load(spark, tables)[1] == list(paths.values())


# --- ranges -------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("closed", ["both", "left", "right", "neither"])
def test_range_joins_meet_each_pair_once(spark, closed):
    rng = random.Random(closed)
    points = [(k, rng.choice("ab"), rng.choice([None, float("nan"), 0.0, 5.0, rng.uniform(-50, 50), rng.randrange(-20, 20)])) for k in range(80)]
    points = [(k, g, None if x is None else float(x)) for k, g, x in points] + [(7, "a", 5.0)] * 2
    spans = []
    for k in range(60):
        a = rng.choice([None, rng.uniform(-60, 60), float(rng.randrange(-20, 20))])
        b = rng.choice([None, (a or 0) + rng.choice([0.0, 1e-12, 0.5, 3.0, 1e6, -1.0])])
        spans.append((100 + k, rng.choice("abc"), a, b))
    left, right = spark.createDataFrame(points, "id long, g string, x double"), spark.createDataFrame(spans, "span long, g string, low double, high double")

    def holds(x, a, b):
        if x is None or x != x:
            return False
        above = a is None or (x >= a if closed in ("both", "left") else x > a)
        return above and (b is None or (x <= b if closed in ("both", "right") else x < b))

    want = sorted((p[0], s[0]) for p in points for s in spans if p[1] == s[1] and holds(p[2], s[2], s[3]))
    call = lambda how: rg.range_join(left, right, ["g"], "x", "low", "high", closed, how)
    inner = call("inner")
    assert sorted((r.id, r.span) for r in inner.collect()) == want and want
    met = {str(p) for p in points for s in spans if p[1] == s[1] and holds(p[2], s[2], s[3])}
    assert sorted(r.id for r in call("left_semi").collect()) == sorted(p[0] for p in points if str(p) in met)
    assert sorted(r.id for r in call("left_anti").collect()) == sorted(p[0] for p in points if str(p) not in met)
    assert sorted((r.id, r.span or 0) for r in call("left").collect()) == sorted(want + [(p[0], 0) for p in points if str(p) not in met])
    plan = inner._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ranges_of_times_and_of_nothing(spark):
    df = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2024-01-01 10:00:00'), (2, timestamp_ntz'2024-01-01 10:00:01') AS v(id, at)").withColumn("k", F.lit(1))
    spans = spark.sql("SELECT 1 AS k, 'w' AS w, timestamp_ntz'2024-01-01 09:00:00' AS low, timestamp_ntz'2024-01-01 10:00:00' AS high")
    assert [r.id for r in rg.range_join(df, spans, ["k"], "at", "low", "high").collect()] == [1]
    for a, b in ((df.where("false"), spans), (df, spans.where("false"))):
        assert rg.range_join(a, b, ["k"], "at", "low", "high").collect() == []
        assert rg.range_join(a, b, ["k"], "at", "low", "high", how="left_anti").count() == a.count()
    with pytest.raises(ValueError, match="both sides"):
        rg.range_join(df, spans.withColumnRenamed("w", "id"), ["k"], "at", "low", "high")


def test_a_long_interval_and_a_hot_bin_do_not_multiply_rows(spark):
    points = spark.range(20_000).select("id", (F.col("id") % 100).cast("double").alias("x"))
    spans = spark.createDataFrame([(1, 0.0, 1e9), (2, 5.0, 5.0), (3, None, None)], "span long, low double, high double").withColumn("g", F.lit(1))
    found = rg.range_join(points.withColumn("g", F.lit(1)), spans, ["g"], "x", "low", "high").groupBy("span").count().collect()
    assert {r.span: r["count"] for r in found} == {1: 20_000, 2: 200, 3: 20_000}


# --- alerts, chains, keys -----------------------------------------------------------------------------------------------------------


def test_alerts_by_the_patterns_rules(spark):
    of = lambda rows, columns: spark.createDataFrame(rows, columns)
    patterns = of([("short", 2, 24, "heat"), ("none", 3, None, "wear"), ("long", 1, 720, "leak"), ("zero", 0, 5, "noise"), ("alone", 1, 1, "x")], "pattern string, threshold long, hours int, failure string")
    holders = of([("e1", "short"), ("e1", "none"), ("e1", "long"), ("e2", "zero"), ("e2", "short"), ("e1", "short"), ("e3", "ghost")], "equipment string, pattern string")
    tags = of([("e1", 1), ("e1", 2), ("e1", 1)], "equipment string, tag long")
    alarms = spark.sql("SELECT * FROM VALUES (1, 1L, timestamp_ntz'2024-01-30 00:00:00'), (2, 1L, timestamp_ntz'2024-01-29 23:59:59.999'), (3, 2L, CAST(NULL AS timestamp_ntz)), (4, 2L, timestamp_ntz'2020-01-01 00:00:00'), (5, 9L, timestamp_ntz'2024-01-30 12:00:00') AS v(alarm, tag, ts)")
    found = {(r.equipment, r.pattern): (r.n_alarms, r.alert) for r in ev.failure_alerts(holders, patterns, tags, alarms, "2024-01-31 00:00:00").collect()}
    assert found == {("e1", "short"): (2, True), ("e1", "none"): (4, True), ("e1", "long"): (4, True), ("e2", "zero"): (0, True), ("e2", "short"): (0, False)}
    assert [r.pattern for r in ev.unassigned_patterns(patterns, holders).collect()] == ["alone"]


def test_chains_enter_a_parameter_once(spark):
    layers = [(f"{a}{k}", f"{b}{k + 1}", "up" if a == b else "down") for k in range(6) for a in "xyz" for b in "xyz"] + [("start", f"{a}0", "up") for a in "xyz"] + [("x3", "start", "down"), ("y1", "y1", "up")]
    rules = spark.createDataFrame(layers, "cause string, effect string, effect_dir string")
    found = [tuple(r) for r in ev.causal_chains(rules, "start", "high").collect()]
    assert len(found) == len(layers) and len(set(found)) == len(found)
    assert ("start(high)>x0(up)>x1(up)", False) in found and {p.split(">")[-1] for p, cyclic in found if cyclic} == {"start(down)", "y1(up)"}
    assert all(p.startswith("start(high)>") for p, _ in found)


def test_row_keys_fall_back(spark):
    rows = [("a", "1", "", "c9", "2024-05-06", None), ("a", "", "h7", "c9", "", "x"), ("", "", " ", "c9", "2024-05", None), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "part string, lot string, saleid string, client_code string, made_date string, OrderDate string")
    get = lambda *a, **k: [r[0] for r in df.select(ig.row_key(*a, columns=df.columns, **k)).collect()]
    assert get(["part", "lot"], c="SaleHistory") == ["a_1_2024-05-06", "h7_x", "c9", None]
    assert get(["part", "lot"], True, c="SaleHistory") == ["a_1", "h7", "c9", None]
    assert get("part", c="SaleHistory") == ["a", "a", "c9", None] and get(None) == ["c9_2024-05-06", "h7_x", "c9", None]
    assert get(["part", "made_date"], c="Thing") == ["a_2024-05-06_2024-05-06", "h7_x", "c9", None] and get(["part", "OrderDate"], c="Thing")[1] == "a_x"


def test_connectivity_names_the_step_that_fails(spark):
    facts = [("a1", "type", "A", "iri"), ("b1", "type", "B", "iri"), ("b2", "type", "B", "iri"), ("c1", "type", "C", "iri"), ("a1", "to", "b1", "iri"), ("c1", "of", "b2", "iri"), ("a1", "also", "b2", "iri")]
    links = spark.createDataFrame([("A", "to", "B"), ("A", "also", "B"), ("C", "of", "B"), ("C", "has", "D"), ("E", "is", "A")], "domain string, p string, range string")
    pairs = spark.createDataFrame([("A", "C"), ("A", "B"), ("C", "D"), ("E", "A"), ("A", "Z"), ("B", "A")], "source string, target string")
    found = {(r.source, r.path): (r.hops, r.n_start, r.reached, r.phase) for r in ev.connectivity(spark.createDataFrame(facts, SPO), links, pairs).collect()}
    assert found == {
        ("A", "A -to> B <of- C"): (2, 1, [1, 0], "step 2"), ("A", "A -also> B <of- C"): (2, 1, [1, 1], "connected"), ("A", "A -to> B"): (1, 1, [1], "connected"), ("A", "A -also> B"): (1, 1, [1], "connected"),
        ("C", "C -has> D"): (1, 1, [0], "step 1"), ("E", "E -is> A"): (1, 0, [0], "no_instances"), ("A", None): (None, 1, None, "no_path"), ("B", "B <to- A"): (1, 2, [1], "connected"), ("B", "B <also- A"): (1, 2, [1], "connected"),
    }
