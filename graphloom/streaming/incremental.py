"""Incremental forms for Structured Streaming: windowed counts with a watermark, and drift for each micro-batch. An extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.analytics import drift


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "720 hours", late: str = "24 hours") -> DataFrame:
    """window_start, key, n; rows later than the watermark are dropped by Spark."""
    own = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return own.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def drift_to(stream: DataFrame, column: str, snapshot: DataFrame, path: str):
    """A query that appends the values of each micro-batch that the snapshot lacks."""
    own = stream.select(F.col(column).cast("string").alias("value"))

    def each(batch: DataFrame, batch_id: int) -> None:
        drift(snapshot, batch).where("change = 'added'").withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(path)

    return own.writeStream.foreachBatch(each)


def resolved_references(children: DataFrame, masters: DataFrame, wait: str, lateness: str = "10 minutes", salts: int = 1) -> DataFrame:
    """A stream of children with the master that their foreign key names: child, fk, at, master, status (resolved, or unresolved).

    children (child, fk, at) and masters (pk, since) are streams with event times. A child whose master has come is resolved at once. Another waits in
    the join's state: for masters up to `wait` after it; when the watermark (the latest event times less lateness) has passed that, it is
    reported once as unresolved, with a null master. A child without a key is unresolved then too. Masters stay known, repeated ones count once, so
    one that came long before serves later children. Of a key that many children share, children are dealt over salts, with the master at each.
    """
    salt = F.pmod(F.xxhash64("child"), F.lit(salts)).cast("int")
    waiting = children.withWatermark("at", lateness).select("child", "fk", "at", salt.alias("salt"))
    known = masters.withWatermark("since", lateness).dropDuplicates(["pk"])
    known = known.select("pk", "since", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("of_salt"))
    in_time = F.col("at") >= F.col("since") - F.expr(f"INTERVAL {wait}")
    joined = waiting.join(known, (F.col("fk") == F.col("pk")) & (F.col("salt") == F.col("of_salt")) & in_time, "left_outer")
    return joined.select("child", "fk", "at", F.col("pk").alias("master"), F.when(F.col("pk").isNull(), "unresolved").otherwise("resolved").alias("status"))


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over all that its sources hold now and return what it wrote to path; its checkpoints lie beside, so a later run goes on from there."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoints").option("path", f"{path}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
