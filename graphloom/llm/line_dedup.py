"""Line deduplication by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import SPACES, let, named, spare, written

MAX_RATIO = 0.08
MIN_PAGES = 3


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(SPACES)))


def _has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(SPACES))) > 0


def boilerplate_lines(pages: DataFrame, host: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, each_row: bool = False) -> DataFrame:
    """The boilerplate lines of each host by hash: host, keys (array).

    A line is boilerplate if it stands on more than max_ratio of the host's pages and on min_pages of
    them or more, where rows of equal text are one page in both counts (a copied document is no boilerplate), unless each_row.
    A host has at most (lines a page) / max_ratio such lines, so keys is bounded however many pages it has.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), _has_word), _key))
    own = pages.select(named(host).alias("host"), keys.alias("keys"), F.md5(text).alias("digest"))
    own = own if each_row else own.distinct()  # keys follows from the text: rows are told apart by host and digest
    # one aggregation for both counts: the null key stands for the page itself
    counted = own.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "keys")).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    counted = written(counted.where((F.col("n") >= min_pages) | F.col("key").isNull()), "line-counts")
    total = counted.where("key is null").select(F.col("host").alias("of"), F.col("n").alias("n_pages"))
    joined = counted.where("key is not null").join(total, F.col("host").eqNullSafe(F.col("of")))
    return joined.where(F.col("n") > F.col("n_pages") * max_ratio).groupBy("host").agg(F.collect_list("key").alias("keys"))


def line_dedup(pages: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, each_row: bool = False) -> DataFrame:
    """pages, all columns, with boilerplate lines dropped from text, and n_dropped (long).

    Lines are parted by \\n and compared without white space at their ends, by 64-bit hashes; lines
    without a word stay. Each page counts once for a line, however often it repeats it, and rows of
    equal text and host are one page. A null host is a host of its own. A null text stays null and an empty one empty; a very long text is
    handled whole. A page that would lose all its words (a near copy of many, or a page of nothing but boilerplate)
    keeps its whole text, n_dropped 0; to choose among such pages is the near deduplication's part. With
    each_row, every row is a page, also a repeated one, and a page of nothing but boilerplate keeps an
    empty text. The column text is found in any case; an existing column n_dropped is
    replaced, and other columns may have any name. An empty table gives an empty result.

    The hosts' lines are joined by host: broadcast by Spark below spark.sql.autoBroadcastJoinThreshold; beyond it pages are
    shuffled by host, and adaptive execution splits a hot host's.
    """
    at, keys = spare(pages, "host_of"), spare(pages, "keys_of")
    found = boilerplate_lines(pages, host, max_ratio, min_pages, each_row)
    found = written(found.select(F.col("host").alias(at), F.col("keys").alias(keys)), "boilerplate")
    text_name = next(c for c in pages.columns if c.lower() == "text")
    kept_columns = [c for c in pages.columns if c.lower() != "n_dropped"]
    text = named(text_name).cast("string")
    joined = pages.join(found, named(host).eqNullSafe(F.col(at)), "left")
    drops = lambda line: _has_word(line) & F.array_contains(F.col(keys), _key(line))
    whole = F.struct(text.alias("text"), F.lit(0).alias("n"))
    cut = lambda all_, left: F.when(F.lit(each_row) | F.exists(left, _has_word), F.struct(F.array_join(left, "\n").alias("text"), (F.size(all_) - F.size(left)).alias("n"))).otherwise(whole)
    done = F.when(F.col(keys).isNull() | text.isNull(), whole)
    done = done.otherwise(let(F.split(text, "\n"), lambda all_: let(F.filter(all_, lambda x: ~drops(x)), lambda left: cut(all_, left))))
    done_at = spare(pages, "done")
    out = joined.select(*[named(c) for c in kept_columns if c != text_name], done.alias(done_at))
    return out.select(*[F.col(done_at)["text"].alias(c) if c == text_name else named(c) for c in kept_columns], F.col(done_at)["n"].cast("long").alias("n_dropped"))
