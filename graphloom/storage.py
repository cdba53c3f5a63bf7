"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a file at most. Triples compress so well that a split by bytes would hold tens of millions, all of which a task's aggregate or shuffle keeps; the cost that
#: Spark counts for opening a file (4 MB) bounds a split's files (some 30), so a split holds 1.5 million rows.
ROWS_A_FILE = 50_000
#: Rows that dealt gives a task about, and the least that are worth one.
ROWS_A_TASK, LEAST_A_TASK = 500_000, 20_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset (as in tests), a new local folder, which only a local master can use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def arranged(df: DataFrame, by: str) -> DataFrame:
    """df dealt by a column and sorted by it, so that the statistics of files and row groups let filters on it skip them.

    Adaptive execution splits the rows of a frequent value among tasks and puts rare ones together, so files have an even size, whatever the values.
    """
    return df.hint("rebalance", by).sortWithinPartitions(by)


def dealt(df: DataFrame, by: list[str], rows: int) -> DataFrame:
    """df, of which rows is the number of rows, dealt by columns to as many tasks as hold ROWS_A_TASK each, so that what a task groups or sorts is bounded.

    Adaptive execution puts partitions together up to a number of bytes, and as many bytes of compressed triples are millions of rows; a stated number stays.
    """
    spread = min(df.sparkSession.sparkContext.defaultParallelism, rows // LEAST_A_TASK)
    return df.repartition(max(1, spread, -(-rows // ROWS_A_TASK)), *by)


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written as a table in the shared folder and read again, arranged by a column if asked."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (arranged(df, by) if by else df).write.option("maxRecordsPerFile", ROWS_A_FILE).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that stored made, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "stored_at", None) if df is not None else None
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
