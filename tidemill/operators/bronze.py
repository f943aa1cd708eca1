"""What ingestion adds to raw rows: content hash, lateness, position against the watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.functions.expressions import tri_state


def record_hash(columns: Sequence[str]) -> Column:
    """SHA-256 over the columns' texts joined by U+001F, null as U+0000."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in columns]), 256)


def window_start(file: Column) -> Column:
    """The start of the period a landing file covers, from its name: __yyyy-MM, __yyyy-MM-dd or __yyyy-MM-ddTHH-mm(part)."""
    key = F.regexp_extract(file, r"__(\d{4}-\d\d(?:-\d\d(?:T\d\d-\d\d)?)?)", 1)
    padded = F.when(F.length(key) == 7, F.concat(key, F.lit("-01T00-00"))).when(F.length(key) == 10, F.concat(key, F.lit("T00-00"))).when(F.length(key) == 16, key)
    return F.try_to_timestamp(padded, F.lit("yyyy-MM-dd'T'HH-mm"))


def late_flag(event: Column, file: Column, zone: str = "Asia/Kolkata") -> Column:
    """'true' if the event, in local time, is before the period of its file; null if either is unknown."""
    return tri_state(F.from_utc_timestamp(event, zone) < window_start(file))


def beyond_watermark(df: DataFrame, batch: str, event: str, delay: str = "interval 2 hours") -> DataFrame:
    """Adds beyond_watermark: 'true' where the event is more than `delay` before the latest of all earlier batches.

    The first batch has nothing to compare with: null. Batches follow each other by name. The running maximum is
    over one row per batch; it is joined back, so no batch is held by one task.
    """
    tops = df.groupBy(batch).agg(F.max(event).alias("__top"))
    seen = F.max("__top").over(W.orderBy(batch).rowsBetween(W.unboundedPreceding, -1))
    marks = tops.select(batch, (seen - F.expr(delay)).alias("__mark"))
    return df.join(marks, batch, "left").withColumn("beyond_watermark", tri_state(F.col(event) < F.col("__mark"))).drop("__mark")
