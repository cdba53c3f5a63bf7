"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chat_format, decontamination, language_id, line_dedup, mixing, near_duplicates, periodic_runs
from graphloom.llm import quality_classifier, quality_rules, secret_scan, token_counts, token_files, whitening
from graphloom.llm.common import shared_folder, table

ACCEPT = 0.3


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    clean = [F.length("clean_text").cast("long").alias("clean_chars"), F.md5("clean_text").alias("clean_md5")]
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", *clean)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn_languages(docs.where(language_id.fold(F.col("doc_id"), 3) != 1))
    done = language_id.identify_languages(docs, model)
    return done.select("doc_id", (language_id.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return done.select("doc_id", "source", "text", "n_dropped")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    done = chat_format.format_reply_trees(chat_format.linear_trees(rows))
    return chat_format.digests(done.select(F.col("root.conv_id").alias("conv_id"), "conversation"), "conv_id")


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_classifier.FactorisationMachine:
    """A machine learnt from labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(language_id.fold(F.col("doc_id"), 5) != 0)
    return quality_classifier.learn_quality(docs, labels.select("doc_id", F.col("quality").alias("label")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = quality_classifier.score_quality(docs, quality_model(spark, docs, sf_dir))
    return done.select("doc_id", (language_id.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.learn_whitening(vectors)
    rows = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = [] if model is None or model.trace <= 0 else (model.eigenvalues / model.trace).tolist()
    told = [
        F.lit(model.n if model else None).cast("long").alias("n"),
        F.expr("try_cast(deviation as bigint)").alias("deviation"),
        "whitened",
        F.get(F.lit(shares).cast("array<double>"), F.col("at")).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    ]
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), *told)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic_runs.repeated_tail(F.col("text"), F.col("doc_id")).alias("text"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary=public_tokenizers.path("word_bpe_49k.json"))
    return token_files.with_crc32(token_files.token_rows(spark, path))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_quality_rules, op2_language_id, op3_token_counts, op4_line_dedup, op5_minhash_near_dedup,
        op6_secret_scan, op7_chat_format, op8_quality_classifier, op9_source_mixing, op10_decontamination,
        op11_embedding_whitening, op12_periodic_runs, op13_token_files,
    )
    return {f.__name__: f for f in own}
