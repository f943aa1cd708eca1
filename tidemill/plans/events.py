"""Queries over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.registry import Registry
from tidemill.sources.tables import instants, table
from tidemill.streaming import windows

query = Registry()
QUERIES, SQL = query.queries, query.sql
_NTZ = lambda df, *cs: df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cs})


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a file stream."""
    schema = table(spark, d, "events").schema
    return instants(spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]"))  # a pattern, as the table may be one file


@query("select date_trunc('hour', ts) as window_start, event_type, cast(count(*) as bigint) as n, cast(sum(cast(value as decimal(18,2))) as decimal(28,2)) as total from events group by 1, 2")
def streaming_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts computed by Structured Streaming over the events as they are available."""
    return _NTZ(windows.run_to_table(windows.tumbling_counts(_stream(spark, d))), "window_start").withColumn("total", F.col("total").cast("decimal(28,2)"))


@query("select time_bucket(interval 15 minute, ts) - interval 15 minute * k as window_start, cast(count(*) as bigint) as n from events, (select unnest([0, 1, 2, 3]) as k) group by 1")
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour, every 15 minutes."""
    return _NTZ(windows.sliding_counts(instants(table(spark, d, "events"))), "window_start")


@query("""with e as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
    s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as session from e)
    select user_id, min(ts) as session_start, max(ts) as last_ts, cast(count(*) as bigint) as n from s group by user_id, session""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user with gaps of 30 minutes."""
    return _NTZ(windows.sessions(instants(table(spark, d, "events"))), "session_start", "last_ts")


@query("select event_id, ts, user_id, event_type from events")
def streaming_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Events once each, by the stream's own state; ids are unique here, so all come out."""
    return _NTZ(windows.run_to_table(windows.deduplicated(_stream(spark, d)).select("event_id", "ts", "user_id", "event_type"), "append"), "ts")
