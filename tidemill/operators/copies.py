"""Messages delivered more than once: exactly one copy of each comes out.

Method: hash aggregation by identifier with min_by over (delivery time, tie-break). Partial aggregation leaves one
row per identifier and map task, so an identifier that holds a third of all rows costs its task next to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.keys import packed_order


def first_copies(df: DataFrame, key: Column, ts: str, row_id: str) -> DataFrame:
    """One row (key, row_id, copies) per non-null key: the id of its earliest copy and how many there are.

    The earliest has the lowest `ts`, then the lowest `row_id`; a null `ts` counts as later than any other.
    Rows with a null key have no identity and do not take part. An empty table gives an empty result.
    """
    rows = df.select(key.alias("key"), F.col(f"`{ts}`").alias("ts"), F.col(f"`{row_id}`").cast("bigint").alias("row_id")).where(F.col("key").isNotNull())
    return rows.groupBy("key").agg(F.min_by("row_id", packed_order(F.col("ts"), F.col("row_id"))).alias("row_id"), F.count("*").alias("copies"))


def surplus_copies(df: DataFrame, key: Column, ts: str, row_id: str) -> DataFrame:
    """The unique `row_id` (as row_id) of every row that is a later copy of another; rows with a null key never are.

    The anti-join runs on the row id, which no two rows share: it cannot be skewed, and only ids are shuffled.
    """
    rows = df.where(key.isNotNull()).select(F.col(f"`{row_id}`").cast("bigint").alias("row_id"))
    return rows.join(first_copies(df, key, ts, row_id).select("row_id"), "row_id", "left_anti")


def keep_one(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The whole earliest row of each non-null key; rows with a null key all stay.

    Earliest by the columns of `order` (nulls last), then by the whole row, so repeated rows leave one copy and the
    result is the same in any partitioning. Columns of `order` and all others must be orderable. Works without
    any unique id and whatever the columns are called; an empty table stays empty.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    at = F.struct(*[x for c in order for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))], *[F.col(f"`{c}`") for c in df.columns if c not in order])
    rows = df.select(key.alias("__key"), row.alias("__row"), at.alias("__at"))
    kept = rows.where(F.col("__key").isNotNull()).groupBy("__key").agg(F.min_by("__row", "__at").alias("__row"))
    return kept.select("__row").union(rows.where(F.col("__key").isNull()).select("__row")).select("__row.*")


def copy_accounting(df: DataFrame, key: Column, ts: str, row_id: str, by: Column) -> DataFrame:
    """Per group `by`: rows, messages and surplus copies (group, rows, messages, surplus), each group on its own; across groups see surplus_accounting."""
    grouped = df.select(by.alias("group"), key.alias("key"))
    per_key = grouped.where(F.col("key").isNotNull()).groupBy("group", "key").agg(F.count("*").alias("n"))
    anonymous = grouped.where(F.col("key").isNull()).groupBy("group").agg(F.count("*").alias("rows"), F.count("*").alias("messages"))
    named = per_key.groupBy("group").agg(F.sum("n").alias("rows"), F.count("*").alias("messages"))
    both = named.unionByName(anonymous).groupBy("group").agg(F.sum("rows").alias("rows"), F.sum("messages").alias("messages"))
    return both.select("group", "rows", "messages", (F.col("rows") - F.col("messages")).alias("surplus"))


def surplus_accounting(df: DataFrame, key: Column, ts: str, row_id: str, by: Column) -> DataFrame:
    """Per group `by`: its rows, the messages whose kept copy it holds and its surplus copies (group, rows, messages, surplus).

    Copies count within and across groups: a message delivered again in a later group is surplus there. Joined on the
    unique row id, as in surplus_copies.
    """
    surplus = surplus_copies(df, key, ts, row_id).withColumn("__s", F.lit(1))
    rows = df.select(by.alias("group"), F.col(f"`{row_id}`").cast("bigint").alias("row_id")).join(surplus, "row_id", "left")
    both = rows.groupBy("group").agg(F.count("*").alias("rows"), F.count("__s").alias("surplus"))
    return both.select("group", "rows", (F.col("rows") - F.col("surplus")).alias("messages"), "surplus")
