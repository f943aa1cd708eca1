"""Totals and averages over trailing periods, days without activity included.

Method: aggregate to days, densify every entity over its calendar, sum over a fixed number of preceding rows. The
calendar rows of an entity are made where its daily rows already are (each row also yields the empty days up to the
next one), so the entity-calendar product is never shuffled; it is sorted once for the window sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.scale import written


def dense_days(daily: DataFrame, entity: Sequence[str], day: str, values: Sequence[str], start: Column | None = None, end: Column | None = None) -> DataFrame:
    """`daily` (one row per entity and day) with a row for every calendar day, null values on the added days.

    The calendar of an entity runs from `start` to `end` (columns or literals); by default from its first to its
    last day. Rows outside are dropped, those with a null day too.
    """
    w = W.partitionBy(*entity).orderBy(day)
    first = F.lag(day).over(w).isNull()
    after = F.lead(day).over(w)
    rows = daily.where(F.col(day).isNotNull())
    if start is not None:
        rows = rows.where(F.col(day) >= start)
    if end is not None:
        rows = rows.where(F.col(day) <= end)
    low = F.when(first, F.least(F.col(day), start)).otherwise(F.col(day)) if start is not None else F.col(day)
    high = F.coalesce(F.date_sub(after, 1), F.greatest(F.col(day), end) if end is not None else F.col(day))
    rows = rows.select(*entity, F.col(day).alias("__day"), *values, low.alias("__low"), high.alias("__high"))
    filled = rows.select(*entity, "__day", *values, F.explode(F.sequence("__low", "__high", F.expr("interval 1 day"))).alias(day))
    here = F.col(day) == F.col("__day")
    return filled.select(*entity, day, *[F.when(here, F.col(v)).alias(v) for v in values])


def rolling_totals(daily: DataFrame, entity: Sequence[str], day: str, values: Mapping[str, str], periods: Sequence[int] = (7, 30), start: Column | None = None, end: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """For every entity and calendar day the totals and averages over the trailing periods.

    `daily` holds one row per entity and day (see daily_values); `values` maps a column to the prefix of its results
    prefix_sum_P and prefix_avg_P for each period of P days ending on the day. A day without a row, or with a null
    value, counts as 0, also before the first row: the average is the total over P. `keep` columns are passed on
    (null on added days). Entities with null keys form groups like any other.
    """
    dense = dense_days(daily, entity, day, [*values, *keep], start, end)
    w = W.partitionBy(*entity).orderBy(day)
    out = [*entity, day, *keep]
    for column, prefix in values.items():
        for p in periods:
            total = F.sum(F.coalesce(F.col(column), F.lit(0).cast(dict(daily.dtypes)[column]))).over(w.rowsBetween(1 - p, 0))
            out += [total.alias(f"{prefix}_sum_{p}"), (total.cast("double") / F.lit(float(p))).alias(f"{prefix}_avg_{p}")]
    return dense.select(*out)


def daily_values(df: DataFrame, entity: Sequence[str], day: str, values: Mapping[str, Column]) -> DataFrame:
    """One row per entity and day with the aggregates of `values`; partial sums make hot entities cheap to shuffle."""
    return df.groupBy(*entity, day).agg(*[c.alias(n) for n, c in values.items()])


def check_moving_average(predictions: DataFrame, entity: Sequence[str], target: str, origin: str, actual: str, claimed: str, period: int = 7, tolerance: float = 0.01) -> DataFrame:
    """Rows of `predictions` whose `claimed` average differs by more than `tolerance` from the recomputed one.

    A day's value is `actual` under that `target` date (the highest, if rows disagree; counted once); the average is
    that of the `period` calendar days ending on `origin`, empty days counting as 0. Adds the column recomputed.
    Rows with a null claim, origin or entity key are no findings.

    The claims of an origin are combined to their lowest and highest before anything is shuffled; only origins of which
    one of these is wrong are joined back to the rows. These are written first, so that Spark knows their size and
    broadcasts them if it is small.
    """
    named = predictions
    for e in entity:
        named = named.where(F.col(e).isNotNull())
    none = F.lit(None).cast("double")
    claim = F.col(claimed).cast("double")
    seen = named.select(*entity, F.col(target).alias("__d"), F.col(actual).cast("double").alias("__v"), none.alias("__least"), none.alias("__most"))
    asked = named.where(claim.isNotNull()).select(*entity, F.col(origin).alias("__d"), none.alias("__v"), claim.alias("__least"), claim.alias("__most"))
    daily = daily_values(seen.unionByName(asked).where(F.col("__d").isNotNull()), entity, "__d", {"__v": F.max("__v"), "__least": F.min("__least"), "__most": F.max("__most")})
    rolled = rolling_totals(daily, entity, "__d", {"__v": "__v"}, (period,), keep=["__least", "__most"])
    mean = F.col(f"__v_avg_{period}")
    off = rolled.where(F.greatest(F.abs(F.col("__least") - mean), F.abs(F.col("__most") - mean)) > tolerance)
    wrong = written(off.select(*entity, F.col("__d").alias(origin), mean.alias("recomputed")), "wrong-averages")
    return named.where(claim.isNotNull()).join(wrong, [*entity, origin]).where(F.abs(claim - F.col("recomputed")) > tolerance)
