"""Column profiles, keys and foreign keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.coercion import normal_key

DATE_LIKE = r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}"
SAMPLE = 100


def unpivoted(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(column, place, value) with every cell as text and a row order to sample by."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(F.struct(*order).alias("place"), cells.alias("cell")).select("cell.column", "place", "cell.value")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_rows, n_null, n_distinct, potential_pk (all distinct and filled, over 10 rows): one aggregation of the table."""
    aggs = [F.count("*").alias("n_rows")]
    for c in columns:
        filled = F.when(F.col(c).cast("string") != "", F.col(c))
        aggs += [F.count(filled).alias(f"{c}__n"), F.count_distinct(filled).alias(f"{c}__d")]
    rows = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("column"), F.col("n_rows"), (F.col("n_rows") - F.col(f"{c}__n")).alias("n_null"), F.col(f"{c}__d").alias("n_distinct")) for c in columns]
    out = rows.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    return out.withColumn("potential_pk", (F.col("n_rows") - F.col("n_null") == F.col("n_distinct")) & (F.col("n_distinct") > 10))


def value_type(value: Column) -> Column:
    return (
        F.when(F.lower(value).isin("true", "false"), "boolean").when(value.rlike(DATE_LIKE), "dateTime").when(value.rlike(r"^[+-]?\d+$"), "integer")
        .when(value.rlike(r"^[+-]?\d*\.\d+([eE][+-]?\d+)?$"), "decimal").otherwise("string")
    )


def dominant_types(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """column, type, mixed over the first non-empty values by order; the earlier seen wins ties."""
    cells = unpivoted(df, columns, order).where("value is not null and value <> ''")
    ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("place"))).where(F.col("rank") <= SAMPLE)
    counted = ranked.groupBy("column", value_type(F.col("value")).alias("type")).agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    best = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "first"))
    return counted.select("column", "type", best.alias("rank"), (F.count("*").over(Window.partitionBy("column")) > 1).alias("mixed")).where("rank = 1").drop("rank")


def quality_score(profiled: DataFrame, types: DataFrame) -> DataFrame:
    """One row: score = max(0, 100 - mean null percent - 5 * mixed columns / columns), to six places."""
    joined = profiled.join(types, "column", "left")
    rate = F.avg(F.col("n_null") * 100.0 / F.greatest("n_rows", F.lit(1)))
    return joined.agg(F.round(F.greatest(F.lit(0.0), F.lit(100.0) - rate - F.lit(5.0) * F.count_if(F.coalesce("mixed", F.lit(False))) / F.count("*")), 6).alias("score"))


def fk_validity(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """One row: n_values, n_missing of distinct non-null foreign keys without a parent."""
    keys = child.where(F.col(fk).isNotNull()).select(F.col(fk).alias("k")).distinct()
    known = parent.select(F.col(pk).alias("k"), F.lit(1).alias("hit")).distinct()
    return keys.join(known, "k", "left").agg(F.count("*").alias("n_values"), F.count_if(F.col("hit").isNull()).alias("n_missing"))


def fk_overlap(child: DataFrame, fk: str, candidates: dict[str, tuple[DataFrame, str]], least: float = 0.8) -> DataFrame:
    """target, overlap of the candidate parents whose keys hold at least that share of the child's distinct values."""
    keys = child.where(F.col(fk).isNotNull()).select(F.col(fk).cast("string").alias("k")).distinct()
    parts = [df.select(F.lit(name).alias("target"), F.col(pk).cast("string").alias("k")).distinct() for name, (df, pk) in candidates.items()]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    hit = keys.join(all_, "k").groupBy("target").agg(F.count("*").alias("n"))
    return hit.crossJoin(keys.agg(F.count("*").alias("total"))).select("target", (F.col("n") / F.col("total")).alias("overlap")).where(F.col("overlap") >= least)


def key_ranking(df: DataFrame, suffixes: tuple[str, ...] = ("id", "code")) -> DataFrame:
    """column, ratio, rank of columns that end in a key suffix, by share of distinct values."""
    columns = [c for c in df.columns if c.lower().endswith(suffixes)]
    rows = df.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(c) for c in columns])
    out = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), (F.col(c) / F.greatest("n", F.lit(1))).alias("ratio")) for i, c in enumerate(columns)])).alias("x")).select("x.*")
    return out.select("column", "ratio", F.row_number().over(Window.orderBy(F.desc("ratio"), "place")).alias("rank"))


def composite_key(df: DataFrame, columns: list[str]) -> list[str]:
    """Greedy composite key: adds the column that makes most distinct tuples, the largest name on ties, until unique or no gain."""
    chosen: list[str] = []
    total, best = df.count(), 0
    while best < total and len(chosen) < len(columns):
        rest = [c for c in columns if c not in chosen]
        row = df.agg(*[F.count_distinct(F.struct(*chosen, c)).alias(c) for c in rest]).first()
        name = max(rest, key=lambda c: (row[c], c))
        if row[name] <= best:
            break
        chosen, best = [*chosen, name], row[name]
    return chosen


def duplicate_keys(df: DataFrame, key: list[str], prefix: str) -> DataFrame:
    """iri, n of instance names that more than one row produces."""
    iri = F.concat(F.lit(prefix), F.concat_ws("_", *[F.col(c).cast("string") for c in key]))
    return df.groupBy(iri.alias("iri")).agg(F.count("*").alias("n")).where("n > 1")


def _edit_blocks(column: str) -> Column:
    """Keys of which two texts at edit distance 1 or 0 share one: hashes of the text and of it without each of its characters.

    Texts that share a key are at distance 2 at most, so a long common part puts no others together.
    """
    x = F.col(column)
    without = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.xxhash64(F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1))))
    return F.explode(F.array_distinct(F.concat(F.array(F.xxhash64(x)), without)))


def fk_ladder(values: DataFrame, column: str, master: DataFrame, key: str, edit: bool = True, prefix: bool = True, compatibility: bool = False) -> DataFrame:
    """value, match, stage of distinct foreign values: exact, then normalised, then edit distance at most 1, then an
    unambiguous prefix of 3 or more characters. The least key wins ties of the first three; edits are sought for
    values without an earlier match, by what is left without one character; prefixes are joined by their first three characters."""
    own = values.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().withColumn("norm", normal_key(F.col("value"), compatibility))
    known = master.where(F.col(key).isNotNull()).select(F.col(key).alias("match")).distinct().withColumn("m_norm", normal_key(F.col("match"), compatibility))
    steps = [
        own.join(known, F.col("value") == F.col("match")).select("value", "match", F.lit(1).alias("stage")),
        own.join(known, F.col("norm") == F.col("m_norm")).select("value", "match", F.lit(2).alias("stage")),
    ]
    if edit:
        rest = own.join(steps[0].unionByName(steps[1]).select("value"), "value", "left_anti")
        blocks, m_blocks = rest.withColumn("block", _edit_blocks("norm")), known.withColumn("block", _edit_blocks("m_norm"))
        met = blocks.join(m_blocks, "block").where((F.abs(F.length("norm") - F.length("m_norm")) <= 1) & (F.levenshtein("norm", "m_norm", 1) >= 0))
        steps.append(met.select("value", "match", F.lit(3).alias("stage")).distinct())
    if prefix:
        met = own.where("length(norm) >= 3").join(known, F.substring("norm", 1, 3) == F.substring("m_norm", 1, 3))
        met = met.where(F.col("m_norm").startswith(F.col("norm")) & (F.length("norm") < F.length("m_norm")))
        steps.append(met.groupBy("value").agg(F.min("match").alias("match"), F.count_distinct("m_norm").alias("n")).where("n = 1").select("value", "match", F.lit(4).alias("stage")))
    all_ = steps[0]
    for s in steps[1:]:
        all_ = all_.unionByName(s)
    best = all_.groupBy("value").agg(F.min(F.struct("stage", "match")).alias("best"))
    return own.select("value").join(best, "value", "left").select("value", "best.match", "best.stage")
