"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import SPACES, WORD_BREAK, words, written

BLOCK_TOKENS = 32
SHARD_TOKENS = 1_000_000
#: The least positive target has so many blocks at least, down to blocks of one word.
LEAST_BLOCKS = 16
#: Shards that are dealt to in one task; more of a source are dealt to by groups first.
GROUP_SHARDS = 1000
MAX_PASSES = 3


def token_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    trimmed = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.regexp_count(trimmed, F.lit(WORD_BREAK)) + 1).cast("long")


def source_targets(sizes: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """Targets of the sources of (source, source_size): source, source_size, target.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the total by weight. A target stops
    at max_passes times its source's size and the excess is shared by weight again. Sources are capped in
    the order of size over weight: the first ones whose share of what the ones before leave exceeds their cap.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    weighed = sizes.withColumn("weight", ((rank - 1) % 3 + 1).cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    seen = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    level = (F.sum("source_size").over(all_) - seen(F.col("source_size") * max_passes)) / (F.sum("weight").over(all_) - seen(F.col("weight")))
    # the level rises while capped sources go and falls behind the first that isn't capped
    levelled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(all_))
    share = F.least(F.col("source_size") * F.lit(float(max_passes)), F.col("level") * F.col("weight"))
    return levelled.select("source", "source_size", share.alias("target"))


def sainte_lague(parties: DataFrame, votes: Column, seats: Column, most: Column, group: list[str]) -> DataFrame:
    """parties with quota: seats of the group dealt one by one to the highest quotient votes / (2 * dealt + 1).

    No party gets more than most. Dealing starts from a floor that every Sainte-Laguë outcome passes: with
    n parties, no quota lies further than 2 + ideal * n / seats from the ideal, so only that band of
    quotients is listed and ranked, never all seats. Ties go by the columns of the party.
    """
    own = Window.partitionBy(*group)
    names = [c for c in parties.columns]
    all_ = parties.withColumns({"_votes": votes.cast("double"), "_seats": seats.cast("double"), "_most": most.cast("long")})
    all_ = all_.withColumns({"_n": F.count("*").over(own), "_sum": F.sum("_votes").over(own)})
    ideal = F.when(F.col("_sum") > 0, F.col("_votes") * F.col("_seats") / F.col("_sum")).otherwise(0.0)
    slack = 2 + ideal * F.col("_n") / F.greatest("_seats", F.lit(1.0))
    all_ = all_.withColumns({"_low": F.least(F.greatest(F.floor(ideal - slack), F.lit(0)), F.col("_most")), "_high": F.least(F.ceil(ideal + slack), F.col("_most"))})
    open_ = all_.withColumn("_open", F.round("_seats").cast("long") - F.sum("_low").over(own))
    steps = open_.where("_high > _low").withColumn("_step", F.explode(F.sequence("_low", F.col("_high") - 1)))
    best = Window.partitionBy(*group).orderBy((F.col("_votes") / (F.col("_step") * 2 + 1)).desc(), *names, "_step")
    won = steps.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= F.col("_open"))
    won = won.groupBy(*names).agg(F.count("*").alias("_won"))
    on = F.lit(True)
    for c in names:
        on = on & F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}"))
    return open_.alias("p").join(won.alias("w"), on, "left").select(*[f"p.{c}" for c in names], (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))


def taken_text(text: Column, size: Column, taken: Column) -> Column:
    """The words taken of a text: the text as often as it is taken whole, then its first words up to the rest, parted by \\n; empty if none is.

    A whole text stays as it is; in one that is cut, white space between words becomes a space.
    """
    passes, rest = F.floor(taken / F.greatest(size, F.lit(1))).cast("int"), (taken % F.greatest(size, F.lit(1))).cast("int")
    first = F.when(rest > 0, F.array(F.array_join(F.slice(words(text), F.lit(1), rest), " "))).otherwise(F.array().cast("array<string>"))
    return F.when(taken > 0, F.array_join(F.concat(F.array_repeat(text, passes), first), "\n")).otherwise("")


def mixed(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, max_passes: int = MAX_PASSES, seed: int = 7, texts: bool = False) -> DataFrame:
    """What a mix of all documents takes of each: doc_id, source, size, source_size, target, shard, taken, and with texts the words taken, as text.

    docs: doc_id, text, source; other columns are ignored, whatever their names. A source is split by a seeded hash into shards of about
    shard_tokens words, so that no task orders a whole hot source. The total is cut into blocks of
    block_tokens words, or of the least positive target div LEAST_BLOCKS where that is fewer (one word at least), so a small source comes
    as near its target as a sixteenth of it, or half a word. Sainte-Laguë deals blocks to the sources by target, then each source's to groups
    of GROUP_SHARDS shards by size, and each group's to its shards, at most max_passes times what they hold. A shard takes all its documents as often as its quota has whole passes,
    and for the rest blocks in seeded order, the last cut where the quota ends; so no document is taken more
    than max_passes times. Null or empty texts have size 0 and are not taken; a null source is a source; repeated rows count each, and of equal
    ones any may be the cut one.
    An empty table gives an empty result. Reruns agree: all orders end with ids. A very long text is one document: it is counted and, with
    texts, cut whole in one task. With texts, each document's text moves once, to its shard.
    """
    own_text = [F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")] if texts else []
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), token_count(F.col("text")).alias("size"), *own_text)
    sized = written(sized, "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, max_passes)
    everything = Window.partitionBy(F.lit(1))
    least = F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything) / LEAST_BLOCKS)
    targets = targets.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_tokens), least)).cast("long"))
    most = lambda size: F.ceil(F.col(size) * max_passes / F.col("block"))
    dealt = sainte_lague(targets.withColumn("all", F.lit(1)), F.col("target"), F.sum("source_size").over(everything) / F.col("block"), most("source_size"), ["all"])
    dealt = dealt.withColumn("n_shards", F.ceil(F.greatest("source_size", F.lit(1)) / F.lit(shard_tokens)))
    dealt = written(dealt.withColumnsRenamed({"source": "of", "quota": "source_quota"}).drop("all"), "source-quotas")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = sized.join(dealt, F.col("source").eqNullSafe(F.col("of"))).withColumn("order", order)
    placed = placed.withColumn("shard", F.pmod(F.conv(F.substring("order", 1, 8), 16, 10).cast("long"), F.col("n_shards"))).drop("of")
    held = placed.groupBy("source", "shard", "source_quota", "block").agg(F.sum("size").alias("shard_size"))
    held = written(held.withColumn("batch", F.floor(F.col("shard") / GROUP_SHARDS)), "shards")
    batches = held.groupBy("source", "source_quota", "block", "batch").agg(F.sum("shard_size").alias("batch_size"))
    batches = sainte_lague(batches, F.col("batch_size"), F.col("source_quota"), most("batch_size"), ["source"])
    batches = batches.select(F.col("source").alias("of"), F.col("batch").alias("of_batch"), F.col("quota").alias("batch_quota"))
    shards = held.drop("source_quota").join(batches, F.col("source").eqNullSafe(F.col("of")) & (F.col("batch") == F.col("of_batch"))).drop("of", "of_batch")
    quotas = sainte_lague(shards, F.col("shard_size"), F.col("batch_quota"), most("shard_size"), ["source", "batch"])
    quotas = written(quotas.select(F.col("source").alias("of"), F.col("shard").alias("part"), "shard_size", "quota"), "shard-quotas")
    ready = placed.join(quotas, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("part")))
    take = F.least(F.col("quota") * F.col("block"), F.col("shard_size") * max_passes)
    until = F.sum("size").over(Window.partitionBy("source", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ready = ready.withColumns({"take": take, "until": until})
    size, whole = F.col("size"), F.greatest("shard_size", F.lit(1))
    rest = F.greatest(F.lit(0), F.least(size, F.col("take") % whole - (F.col("until") - size)))
    taken = F.floor(F.col("take") / whole) * size + rest
    chosen = ready.select("doc_id", "source", "size", "source_size", "target", "shard", taken.cast("long").alias("taken"), *(["text"] if texts else []))
    return chosen.withColumn("text", taken_text(F.col("text"), F.col("size"), F.col("taken"))) if texts else chosen
