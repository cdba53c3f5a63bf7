"""A corpus pipeline of five stages over documents; each stage's rows are written and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontamination, line_dedup, mixing, near_duplicates, quality_classifier
from graphloom.llm.common import named, spare, table, written
from graphloom.llm.queries import ACCEPT, quality_model


def aside(docs: DataFrame, name: str) -> tuple[DataFrame, list[Column]]:
    """docs with a column of that name, in any case, under a spare one; and the columns that give docs back."""
    to = {c: spare(docs, f"{c}_aside") if c.lower() == name else c for c in docs.columns}
    return docs.select(*[named(c).alias(x) for c, x in to.items()]), [named(x).alias(c) for c, x in to.items()]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts are scored too, repeated rows each, a very long text whole, an empty table stays empty.

    Other columns stay as they are, whatever their names, score too.
    """
    model = quality_model(spark, docs, sf_dir)
    safe, own = aside(docs, "score")
    return quality_classifier.with_quality(safe, model).where(F.col("score") >= ACCEPT).select(*own)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; n_chars follows the text. Null and empty texts, and pages that would lose all their words, stay as they are; a null source is one.

    A very long text is cut whole, an empty table stays empty, and other columns stay as they are, whatever their names, n_dropped too.
    """
    safe, own = aside(docs, "n_dropped")
    done = line_dedup.line_dedup(safe)
    return done.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else x for c, x in zip(docs.columns, own, strict=True)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id stays, with all its rows where they repeat; null ids and texts without words stay.

    A very long text is compared whole, an empty table stays empty, and other columns stay as they are, whatever their names.
    """
    gone = near_duplicates.near_duplicate_classes(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[named(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null ids and texts without words stay.

    A very long text is searched whole, an empty table stays empty, and other columns stay as they are, whatever their names.
    """
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: counts, and the text of the words taken. Null and empty texts take nothing, repeated rows count each, a null source is one.

    A very long text is cut whole, an empty table gives an empty result, and other columns are not part of it, whatever their names.
    """
    return mixing.mixed(docs, texts=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix),
]

#: The first stage is a learned model, which SQL can't express; the tests hold each of the five stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
