"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

Test items are short and documents long, so similarity of whole sets says nothing; what counts is the
share of an item's shingles that a document contains. Items are partitioned by the size of their
shingle set, and each partition sets how many of an item's least-hashed shingles (its MinHash sketch)
stand for it and how many of those a document must hold to become a candidate. A document that
contains 75 % of an item holds any one sketched shingle with that probability, however long it is. Candidates
are then verified by exact containment of the items' full shingle sets, compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, let, named, words, written

WIDTH = 5
#: (least set size of the partition, sketch size, sketched shingles to hold). Larger items have larger sketches and ask for more
#: of them, so fewer documents become candidates by chance. A document with 75 % of an item holds fewer than
#: 4 of 24, 6 of 32 or 12 of 48 sketched shingles with a probability of 2e-10, 3e-12 or 6e-14 at most; sets of
#: up to 24 shingles are sketched whole and a document may then miss a quarter of them at most.
PARTITIONS = ((1, 24, 1), (4, 24, 2), (16, 24, 3), (25, 24, 4), (64, 32, 6), (256, 48, 12))


def shingles(text: Column, hashed: bool) -> Column:
    """All 5-word shingles of a text in order (as hashes, or as text); with one to four words the whole sequence, without words none."""

    def of_words(own: Column) -> Column:
        n = F.size(own)
        if hashed:
            at = lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(WIDTH)])
            # a sequence of fewer words is hashed with nulls in the missing places, like any other window
            return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - WIDTH, F.lit(0))), at))
        at = lambda i: F.array_join(F.slice(own, i + 1, WIDTH), " ")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - WIDTH, F.lit(0))), at))

    return let(words(ascii_lower(F.coalesce(text.cast("string"), F.lit("")))), of_words)


def item_sketches(items: DataFrame) -> DataFrame:
    """The sketch of each item of (item_id, shingle, n_item): item_id, hash, needed."""
    partition = lambda place: F.coalesce(*[F.when(F.col("n_item") >= p[0], F.lit(p[place])) for p in reversed(PARTITIONS)])
    order = Window.partitionBy("item_id").orderBy(F.xxhash64(F.lit("sketch"), "hash"), "hash")
    ranked = items.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= partition(1)).select("item_id", "hash", partition(2).alias("needed"))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """Documents that contain a benchmark item: doc_id, item_id, n_shared, n_item.

    docs: doc_id and text; benchmark: item_id and text; other columns are ignored. A pair is returned
    if 100 * n_shared >= percent * n_item, for the distinct 5-word shingles (A-Z lower-cased) of the
    item; an item of fewer words is one shingle, which only an equally short document holds. Null or
    empty texts hold nothing and null ids are left out; a very long text is searched whole, and an empty table gives an empty result. Rows that repeat an id and text count once; texts that repeat a doc_id
    count as one document, items that repeat an item_id as one item. The join with the sketches is
    broadcast by Spark while they are below spark.sql.autoBroadcastJoinThreshold, and is a shuffle beyond it.
    """
    as_text = benchmark.where("item_id is not null").select("item_id", F.explode(shingles(F.col("text"), False)).alias("shingle"))
    as_text = as_text.distinct()
    sizes = as_text.groupBy("item_id").agg(F.count("*").alias("n_item"))
    parts = F.split("shingle", " ")
    items = as_text.join(sizes, "item_id").withColumn("hash", F.xxhash64(*[F.get(parts, F.lit(k)) for k in range(WIDTH)]))
    items = written(items, "items")
    sketches = written(item_sketches(items), "item-sketches")

    # the array is made in a filter's stead below the join: each document's hashes that no sketch has go at once
    held = docs.where("doc_id is not null").select("doc_id", F.explode(shingles(F.col("text"), True)).alias("hash")).join(sketches, "hash")
    hits = held.groupBy("doc_id", "item_id", "needed").agg(F.count_distinct("hash").alias("hits"))
    candidates = written(hits.where("hits >= needed").select("doc_id", "item_id"), "candidates")

    ids = candidates.select("doc_id").distinct()
    again = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    whole = again.select("doc_id", F.explode(F.array_distinct(shingles(F.col("text"), False))).alias("shingle"))
    # a document meets the shingles of its own candidates only, also where other items share them
    asked = candidates.join(items.select("item_id", "shingle", "n_item"), "item_id")
    shared = whole.join(asked, ["doc_id", "shingle"])
    counted = shared.groupBy("doc_id", "item_id", "n_item").agg(F.count_distinct("shingle").alias("n_shared"))
    return counted.where(F.col("n_shared") * 100 >= F.col("n_item") * percent).select("doc_id", "item_id", "n_shared", "n_item")


def decontaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """The documents, all columns whatever their names, that contain no benchmark item; those with a null doc_id or text stay."""
    found = written(contaminated_pairs(docs, benchmark, percent).select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select(*[named(c) for c in docs.columns])
