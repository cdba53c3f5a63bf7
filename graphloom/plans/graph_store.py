"""A graph kept in the shared folder and shared by all queries: each source table's triples under the fingerprint of its files.

A table is converted when its fingerprint is first seen; later loads read its triples. When a table's files change, only its own triples are
written anew. A conversion is a union with a branch for each property, and a task writes rows of one branch, as they come: nothing is dealt or sorted, and a
query that filters by property reads those files only, by their statistics.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import ROWS_A_FILE, shared_folder

Conversion = Callable[[SparkSession, str], DataFrame]


def fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-256 of names, sizes and times of change of the files under a path. Files are listed by Spark; none is opened."""
    files = spark.read.format("binaryFile").load(path).select(F.concat_ws("\t", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")).alias("file"))
    # a line a file is hashed where it is listed; the hashes add up in any order
    parts = files.select(F.conv(F.substring(F.sha2("file", 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
    total = parts.agg(F.count("*").alias("n"), F.sum("h").alias("h"), F.bit_xor(F.col("h").cast("long")).alias("x")).first()
    return f"{total.n}-{total.h}-{total.x}"


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def store_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/graph-store"


def _name(spark: SparkSession, text: str) -> str:
    return spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0][:32]


def kept_table(spark: SparkSession, path: str, convert: Conversion, mapping: str) -> tuple[DataFrame, bool]:
    """The triples of the table at path, and whether they had to be written. mapping names how it is converted: another mapping is another entry.

    Triples are written to a folder of their own, which is then renamed to the entry, so no reader sees half of one; of two writers the first one stays.
    """
    entry = f"{store_root(spark)}/{_name(spark, f'{path}|{mapping}')}-{_name(spark, fingerprint(spark, path))}"
    where, files = _folder(spark, entry)
    fresh = not files.exists(where)
    if fresh:
        draft = f"{store_root(spark)}/draft-{uuid.uuid4().hex}"
        convert(spark, path).write.option("maxRecordsPerFile", ROWS_A_FILE).parquet(draft)
        if files.exists(where) or not files.rename(_folder(spark, draft)[0], where):
            files.delete(_folder(spark, draft)[0], True)
    return spark.read.parquet(entry), fresh


def load(spark: SparkSession, tables: dict[str, tuple[Conversion, str]]) -> tuple[DataFrame, list[str]]:
    """The graph of tables (path: conversion and name of its mapping), and the paths of those that had to be converted."""
    parts, written = [], []
    for path, (convert, mapping) in tables.items():
        part, fresh = kept_table(spark, path, convert, mapping)
        parts.append(part)
        written += [path] if fresh else []
    return reduce(DataFrame.unionByName, parts), written


def forget(spark: SparkSession) -> None:
    """Delete the store."""
    where, files = _folder(spark, store_root(spark))
    files.delete(where, True)
