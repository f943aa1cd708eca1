"""Windowed aggregations over event streams; each function works on a stream and on a batch DataFrame alike."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.scale import shared_dir


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and mean value per type and fixed window; state older than the watermark is dropped in a stream."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """Events per overlapping window."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"))
    return g.agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events less than `gap` apart."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).select("user_id", F.col("w.start").alias("session_start"), "last_ts", "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Each event once although delivered more than once; the state is bounded by the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def followed_by(first: DataFrame, second: DataFrame, within: str = "10 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, first_id, second_id): events of `second` at most `within` after one of `first` by the same user.

    Both sides carry watermarks and the join bounds their distance, so a stream drops its state of pairs that can no longer come.
    """
    a = first.withWatermark("ts", late).select(F.col("user_id"), F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = second.withWatermark("ts", late).select(F.col("user_id").alias("other"), F.col("event_id").alias("second_id"), F.col("ts").alias("second_ts"))
    near = (F.col("user_id") == F.col("other")) & (F.col("second_ts") >= F.col("first_ts")) & (F.col("second_ts") <= F.col("first_ts") + F.expr(f"interval {within}"))
    return a.join(b, near).select("user_id", "first_id", "second_id")


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is available and returns its result as a table in the shared folder.

    In complete mode every micro-batch writes the whole result; the last one counts.
    """
    spark, path, last = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}", []

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch-{epoch}")
        last[:] = [*last, epoch] if mode == "append" else [epoch]

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{path}/epoch-{e}" for e in last])
