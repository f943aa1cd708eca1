"""Column-level data quality profile of the loads of a table.

Method: the values of all columns are unpivoted, equal ones combined by hash aggregation, and range-sorted by column and
value. Distincts and top frequencies rest on the hash aggregation alone. Every partition holds one stretch of the sorted
values: counts per partition prefixed over the partitions give exact ranks (quantiles), and the differences of two loads'
cumulative curves, merged over the partitions, give exact Kolmogorov-Smirnov distances.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemill.scale import map_arrow, written


@dataclass(frozen=True)
class Profiled:
    """A column to profile: what its values must match (`pattern`, strings) or lie in (`low`..`high`, numbers).

    `dominance`: whether one value holding most of a load is remarkable (it is not for identifiers or foreign keys).
    """

    name: str
    pattern: str | None = None
    low: float | None = None
    high: float | None = None
    dominance: bool = True


_EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)


def _kind(t: T.DataType) -> str:
    """number: exact as a double; wide: ordered as a double, told apart by its text; text: everything else."""
    if isinstance(t, _EXACT) or isinstance(t, T.DecimalType) and t.precision <= 15:
        return "number"
    return "wide" if isinstance(t, (T.LongType, T.DecimalType)) else "text"


def load_sizes(df: DataFrame, load: str, columns: Sequence[Profiled]) -> DataFrame:
    """(load, lid, c, rows, filled): per load and column index c, its rows and non-null values; one hash aggregation.

    Loads are known by the 64-bit hash lid from here on. Rows with a null load count as one more load.
    """
    counts = df.groupBy(F.col(f"`{load}`").cast("string").alias("load")).agg(F.count("*").alias("rows"), *[F.count(F.col(f"`{p.name}`")).alias(f"f{i}") for i, p in enumerate(columns)])
    pairs = F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("c"), F.col(f"f{i}").alias("filled")) for i in range(len(columns))]))
    return counts.select("load", F.xxhash64("load").alias("lid"), "rows", pairs.alias("p")).select("load", "lid", "p.c", "rows", "p.filled")


def value_counts(df: DataFrame, load: str, columns: Sequence[Profiled]) -> DataFrame:
    """(c, lid, x, s, n): every non-null value of every column with its count per load, combined before the shuffle.

    x is the value as a double (numbers), s its text (strings and numbers a double cannot hold); NaN is one value.
    """
    each = []
    for i, p in enumerate(columns):
        v, kind = F.col(f"`{p.name}`"), _kind(df.schema[p.name].dataType)
        x = v.cast("double") if kind != "text" else F.lit(None).cast("double")
        s = v.cast("string") if kind != "number" else F.lit(None).cast("string")
        each.append(F.struct(F.lit(i).cast("tinyint").alias("c"), x.alias("x"), s.alias("s")))
    rows = df.select(F.xxhash64(F.col(f"`{load}`").cast("string")).alias("lid"), F.explode(F.array(*each)).alias("v")).select("v.c", "lid", "v.x", "v.s")
    return rows.where(F.col("x").isNotNull() | F.col("s").isNotNull()).groupBy("c", "lid", "x", "s").agg(F.count("*").alias("n"))


def range_sorted(counts: DataFrame, *within: str) -> DataFrame:
    """`counts` range-partitioned by column and value, so that equal values meet; sorted inside each partition.

    No value is hot here: equal ones of a load are one row already. The number of partitions is fixed, so the
    partition ids stay the same in every use of the shuffle.
    """
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counts.repartitionByRange(n, "c", "x", "s").sortWithinPartitions(*within)


def run_totals(df: DataFrame, load: str, columns: Sequence[Profiled]) -> DataFrame:
    """Per load and column, from the combined values (unique per load and column; their order does not matter here).

    distinct, top (the highest frequency), low/high (extremes as text), odd (values that do not match the pattern or
    are outside the range), inside and inside_sum (values in the range).
    """
    runs = range_sorted(value_counts(df, load, columns), "c", "x", "s")
    odd, ranged = F.lit(False), F.lit(False)
    for i, p in enumerate(columns):
        here = F.col("c") == i
        if p.pattern is not None:
            odd = F.when(here, ~F.col("s").rlike(rf"\A(?:{p.pattern})\z")).otherwise(odd)
        if p.low is not None or p.high is not None:
            out = F.isnan("x")
            out |= F.col("x") < p.low if p.low is not None else F.lit(False)
            out |= F.col("x") > p.high if p.high is not None else F.lit(False)
            odd = F.when(here, out).otherwise(odd)
        if _kind(df.schema[p.name].dataType) != "text":
            ranged = F.when(here, F.lit(True)).otherwise(ranged)
    runs = runs.withColumns({"odd": odd, "inside": ranged & ~odd})
    return runs.groupBy("c", "lid").agg(
        F.count("*").alias("distinct"),
        F.max("n").alias("top"),
        F.min("x").alias("x_low"),
        F.max("x").alias("x_high"),
        F.min("s").alias("s_low"),
        F.max("s").alias("s_high"),
        F.sum(F.when(F.col("odd"), F.col("n")).otherwise(0)).alias("odd"),
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"),
        F.sum(F.when(F.col("inside"), F.col("n") * F.col("x"))).alias("inside_sum"),
    )


def column_profile(df: DataFrame, load: str, columns: Sequence[Profiled]) -> DataFrame:
    """One row per load and column, with the same measures of the whole table beside them (prefix all_).

    load, column_name, rows, filled, null_share, distinct, top_share, low, high, odd_share, inside_mean, all_null_share,
    all_odd_share, all_inside_mean. Shares of an empty or all-null column are null. An empty table gives no row.
    """
    name = F.array(*[F.lit(p.name) for p in columns])
    both = load_sizes(df, load, columns).join(run_totals(df, load, columns), ["c", "lid"], "left")
    w = W.partitionBy("c")
    share = lambda a, b: F.try_divide(F.coalesce(a, F.lit(0)).cast("double"), b.cast("double"))
    return both.select(
        "load",
        F.get(name, F.col("c")).alias("column_name"),
        "c",
        "lid",
        "rows",
        "filled",
        share(F.col("rows") - F.col("filled"), F.col("rows")).alias("null_share"),
        F.coalesce("distinct", F.lit(0)).alias("distinct"),
        share(F.col("top"), F.col("filled")).alias("top_share"),
        F.coalesce("s_low", F.col("x_low").cast("string")).alias("low"),
        F.coalesce("s_high", F.col("x_high").cast("string")).alias("high"),
        share(F.col("odd"), F.col("filled")).alias("odd_share"),
        F.try_divide(F.col("inside_sum"), F.col("inside")).alias("inside_mean"),
        share(F.sum(F.col("rows") - F.col("filled")).over(w), F.sum("rows").over(w)).alias("all_null_share"),
        share(F.sum("odd").over(w), F.sum("filled").over(w)).alias("all_odd_share"),
        F.try_divide(F.sum("inside_sum").over(w), F.sum("inside").over(w)).alias("all_inside_mean"),
    )


def remarkable(profile: DataFrame, columns: Sequence[Profiled], more: float = 0.10, factor: float = 1.5, most: float = 0.5) -> DataFrame:
    """(load, column_name, aspect) for each way in which a load's column stands out from the whole table.

    'nulls', 'pattern', 'range': the share is over `more` above the table's. 'distribution': the mean of the values in
    range is over `factor` times the table's or under 1/`factor` of it. 'dominance': one value holds over `most` of the
    non-null values. Rows with a null load stand for no load.
    """
    names = lambda ok: [p.name for p in columns if ok(p)]
    c, bounded = F.col("column_name"), lambda p: p.low is not None or p.high is not None
    mean, every = F.col("inside_mean"), F.col("all_inside_mean")
    aspects = {
        "nulls": F.col("null_share") - F.col("all_null_share") > more,
        "pattern": c.isin(names(lambda p: p.pattern is not None)) & (F.col("odd_share") - F.col("all_odd_share") > more),
        "range": c.isin(names(bounded)) & (F.col("odd_share") - F.col("all_odd_share") > more),
        "distribution": c.isin(names(bounded)) & ((mean > every * factor) | (mean < every / factor)),
        "dominance": c.isin(names(lambda p: p.dominance)) & (F.col("top_share") > most),
    }
    found = F.array_compact(F.array(*[F.when(ok, F.lit(a)) for a, ok in aspects.items()]))
    return profile.where(F.col("load").isNotNull()).select("load", "column_name", F.explode(found).alias("aspect"))


_CUMULATED = "pid int, c tinyint, g bigint, x double, s string, w double, cum double, end boolean"


def _cumulate(batches: Iterator) -> Iterator:
    """Adds to rows sorted by (c, g, x, s) the sum of w within (c, g) so far and whether the row ends its value.

    One carry, that of the last (c, g), passes from batch to batch: memory is that of a batch.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def differs(a: pa.Array) -> np.ndarray:
        one, two = a[1:], a[:-1]
        return np.asarray(pc.fill_null(pc.not_equal(one, two), True)) & ~np.asarray(pc.and_(pc.is_null(one), pc.is_null(two)))

    carry, held, final = 0.0, None, None  # held: the last row so far, as the next batch tells whether it ends its value
    for batch in batches:
        t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        if not t.num_rows:
            continue
        c, g, w = (np.asarray(t[k]) for k in ("c", "g", "w"))
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (g[1:] != g[:-1])
        start = np.flatnonzero(new)
        sums = np.cumsum(w)
        base = np.concatenate([[-carry], sums[start[1:] - 1]])
        cum = sums - np.repeat(base, np.diff(np.append(start, len(c))))
        end = np.ones(len(c), bool)
        end[:-1] = new[1:] | differs(t["x"].combine_chunks()) | differs(t["s"].combine_chunks())
        done = t.append_column("cum", pa.array(cum)).append_column("end", pa.array(end)).to_batches()[0]
        yield done.slice(0, len(c) - 1)
        held, final, carry = t.to_batches()[0].slice(len(c) - 1), done.slice(len(c) - 1), cum[-1] - w[-1]
    if final is not None:
        yield final


def _curves(weighted: DataFrame) -> DataFrame:
    """(c, g, x, s, w) range-sorted, with partition id, local cumulative weight and ends of values.

    Written, as every use of it must see the same partitions: a range shuffle that ran again would sample other bounds.
    """
    at = range_sorted(weighted, "c", "g", "x", "s").select(F.spark_partition_id().alias("pid"), "c", "g", "x", "s", F.col("w").cast("double").alias("w"))
    return written(map_arrow(at, _cumulate, _CUMULATED), "curves")


def load_quantiles(df: DataFrame, load: str, columns: Sequence[Profiled], at: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """(load, column_name, q, value): exact discrete quantiles, the lowest value at which the cumulative share is >= q.

    Values as text. Columns without a value in a load have no row.
    """
    curves = _curves(value_counts(df, load, columns).select("c", F.col("lid").alias("g"), "x", "s", F.col("n").alias("w")))
    before = F.coalesce(F.sum("held").over(W.partitionBy("c", "g").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    parts = curves.groupBy("pid", "c", "g").agg(F.sum("w").alias("held"))
    parts = parts.select("pid", "c", "g", "held", before.alias("before"), F.sum("held").over(W.partitionBy("c", "g")).alias("total"))
    ranks = parts.select("*", F.explode(F.array(*[F.lit(float(q)) for q in at])).alias("q")).withColumn("rank", F.greatest(F.lit(1.0), F.ceil(F.col("q") * F.col("total") - 1e-9).cast("double")) - F.col("before"))
    ranks = ranks.where((F.col("rank") > 0) & (F.col("rank") <= F.col("held"))).select("pid", "c", "g", "q", "rank")
    hits = curves.join(ranks, ["pid", "c", "g"]).where((F.col("cum") - F.col("w") < F.col("rank")) & (F.col("rank") <= F.col("cum")))
    names = load_sizes(df, load, columns).select("load", F.col("lid").alias("g"), "c")
    name = F.get(F.array(*[F.lit(p.name) for p in columns]), F.col("c"))
    return hits.join(names, ["c", "g"]).select("load", name.alias("column_name"), "q", F.coalesce("s", F.col("x").cast("string")).alias("value"))


def load_drift(df: DataFrame, load: str, columns: Sequence[Profiled]) -> DataFrame:
    """(load, previous, column_name, ks): the exact Kolmogorov-Smirnov distance of each load's values to the load before.

    Loads follow each other by name, among those with values in the column; the first has no row. Each value counts
    in its own load with weight 1/N and against the following one with -1/N: the distance is the largest absolute
    cumulative sum, found per partition and shifted by what the partitions before it sum up to.
    """
    sizes = load_sizes(df, load, columns).where(F.col("load").isNotNull() & (F.col("filled") > 0))
    w = W.partitionBy("c").orderBy("load")
    order = sizes.select("c", "lid", "load", "filled", F.lag("load").over(w).alias("previous"), F.lead("lid").over(w).alias("next"))
    counted = value_counts(df, load, columns).join(order.select("c", "lid", "filled", "previous", "next"), ["c", "lid"])
    share = F.col("n") / F.col("filled")
    sides = F.array(F.when(F.col("previous").isNotNull(), F.struct(F.col("lid").alias("g"), share.alias("w"))), F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("g"), (-share).alias("w"))))
    curves = _curves(counted.select("c", "x", "s", F.explode(F.array_compact(sides)).alias("e")).select("c", "e.g", "x", "s", "e.w"))
    parts = curves.groupBy("pid", "c", "g").agg(F.sum("w").alias("held"), F.max(F.when(F.col("end"), F.col("cum"))).alias("up"), F.min(F.when(F.col("end"), F.col("cum"))).alias("down"))
    before = F.coalesce(F.sum("held").over(W.partitionBy("c", "g").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    parts = parts.withColumn("before", before)
    ks = parts.groupBy("c", "g").agg(F.max(F.greatest(F.col("before") + F.col("up"), -F.col("before") - F.col("down"))).alias("ks"))
    name = F.get(F.array(*[F.lit(p.name) for p in columns]), F.col("c"))
    return ks.join(order.select("c", F.col("lid").alias("g"), "load", "previous"), ["c", "g"]).select("load", "previous", name.alias("column_name"), F.round(F.greatest("ks", F.lit(0.0)), 9).alias("ks"))
