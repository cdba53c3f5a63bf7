"""Joins that make many pairs: none lost or met twice, spread over tasks whatever the key."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph as gr
from graphloom.operators import pairs as pa
from graphloom.operators import profile as pr
from graphloom.operators import ranges as rg
from graphloom.operators import reasoning as rs
from graphloom.operators import rules as ru
from graphloom.plans import graph_store as gs


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(pa, "SIDE", 7)
    monkeypatch.setattr(pa, "TASK_PAIRS", 200)


def most_in_a_task(df):
    counts = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(counts), sum(counts)


def test_edits_of_names_with_a_common_start_meet_near_ones_only(spark):
    names = spark.range(400).select(F.format_string("supplier%06d", F.col("id") * 37).alias("k"))
    blocks = names.withColumn("block", pr._edit_blocks("k"))
    assert blocks.alias("x").join(blocks.alias("y"), "block").count() < 400 * 60
    texts = ["", "a", "b", "ab", "ba", "abc", "abcd", "xbcd", "abxd", "abcde", "aab", "é", "éa"]
    one, two = (spark.createDataFrame([(x,) for x in texts], f"{c} string") for c in "ab")
    met = one.withColumn("block", pr._edit_blocks("a")).join(two.withColumn("block", pr._edit_blocks("b")), "block").where(F.levenshtein("a", "b") <= 1).select("a", "b").distinct()
    assert {tuple(r) for r in met.collect()} == {tuple(r) for r in one.crossJoin(two).where(F.levenshtein("a", "b") <= 1).collect()}


def test_pairs_of_a_path_are_spread_and_distinct(spark, small_blocks):
    out = spark.range(60).select(F.concat(F.lit("s"), "id").alias("a"), F.lit("n").alias("b"))
    into = spark.range(80).select(F.lit("n").alias("a"), F.concat(F.lit("c"), "id").alias("b"))
    found = gr.sequence_path(out, into)
    most, total = most_in_a_task(found)
    assert total == 4800 and most < 1600 and found.distinct().count() == 4800
    both = spark.createDataFrame([("x", "m"), ("x", "n"), ("y", "m")], "a string, b string")
    then = spark.createDataFrame([("m", "c1"), ("n", "c1"), ("n", "c2")], "a string, b string")
    assert sorted(tuple(r) for r in gr.sequence_path(both, then).collect()) == [("x", "c1"), ("x", "c2"), ("y", "c1")]


def test_pairs_of_a_bucket_are_spread(spark, small_blocks):
    left, right = spark.range(50).selectExpr("id as l", "if(id % 10 = 9, null, id % 2) as g"), spark.range(90).selectExpr("id as r", "id % 3 as h")
    found = ru.bucket_join(left, F.col("l"), F.col("g"), right, F.col("r"), F.col("h"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((a, b) for a in range(50) if a % 10 != 9 for b in range(90) if a % 2 == b % 3)
    one = ru.bucket_join(left.where("g = 0"), F.col("l"), F.col("g"), right.where("h = 0"), F.col("r"), F.col("h"))
    most, total = most_in_a_task(one)
    assert total == 25 * 30 and most < 500


def test_intervals_of_a_hot_bin_are_spread(spark, small_blocks):
    points, spans = spark.range(60).selectExpr("1 as g", "id as p", "id % 5 as x"), spark.range(40).selectExpr("1 as g", "id as s", "0 as low", "10 as high")
    most, total = most_in_a_task(rg.range_join(points, spans, ["g"], "x", "low", "high"))
    assert total == 2400 and most < 1200


def test_pairs_of_a_rule_are_spread_and_distinct(spark, small_blocks):
    t = spark.range(60).selectExpr("concat('s', id) as s", "'in' as p", "'n' as o").union(spark.createDataFrame([("s1", "in", "m"), ("s2", "in", "m")], "s string, p string, o string"))
    body = gr.match(t, "?a", "in", "?n"), gr.match(t, "?b", "in", "?n")
    found = rs.rule_body(*body, where=F.col("a") != F.col("b"), head=("?a", "near", "?b"), on_head=True)
    most, total = most_in_a_task(found)
    assert total == 60 * 59 and most < 1200
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in rs.rule_body(*body, where=F.col("a") != F.col("b"), head=("?a", "near", "?b")).collect()}


def test_files_of_the_store_have_one_property_and_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gs, "ROWS_A_FILE", 300)
    spark.range(1000).selectExpr("concat('s', id) as s").write.parquet(str(tmp_path / "rows"))
    convert = lambda spark, path: spark.read.parquet(path).selectExpr("s", "'p' as p", "s as o").union(spark.read.parquet(path).selectExpr("s", "'q' as p", "'x' as o"))
    kept, fresh = gs.kept_table(spark, str(tmp_path / "rows"), convert, "two properties")
    files = kept.groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.count_distinct("p").alias("ps")).collect()
    assert fresh and kept.count() == 2000 and all(f.n <= 300 and f.ps == 1 for f in files)
