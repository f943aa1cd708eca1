from datetime import datetime

from pyspark.sql import functions as F

from tidemill.functions.keys import norm_key, packed_order
from tidemill.operators.copies import copy_accounting, first_copies, keep_one, surplus_accounting, surplus_copies

T = [datetime(2025, 1, d) for d in range(1, 9)]
SCHEMA = "row_id bigint, k string, ts timestamp_ntz, key string, copies int, body string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_earliest_stays_ties_by_id_nulls_last(spark):
    df = frame(
        spark,
        [
            (1, "a", T[2], "x", 1, ""),
            (2, " A ", T[1], "x", 1, None),
            (3, "a", T[1], None, 1, "z" * 100_000),
            (4, "b", None, "x", 1, "q"),
            (5, "B", T[5], "x", None, "q"),
            (6, None, T[0], "x", 1, "q"),
            (7, None, T[0], "x", 1, "q"),
            (-8, "c", T[3], "x", 1, "q"),
            (9, "c", T[3], "x", 1, "q"),
        ],
    )
    key = norm_key(F.col("k"))
    assert {r.row_id for r in surplus_copies(df, key, "ts", "row_id").collect()} == {1, 3, 4, 9}
    assert {(r.key, r.row_id, r.copies) for r in first_copies(df, key, "ts", "row_id").collect()} == {("A", 2, 3), ("B", 5, 2), ("C", -8, 2)}
    assert sorted(r.row_id for r in keep_one(df, key, ["ts", "row_id"]).collect()) == [-8, 2, 5, 6, 7]
    assert keep_one(df, key, ["ts"]).columns == df.columns


def test_repeated_rows_leave_one_copy(spark):
    row = (1, "a", T[0], "x", 1, "body")
    assert [tuple(r) for r in keep_one(frame(spark, [row] * 5), F.col("k"), ["ts"]).collect()] == [row]


def test_empty(spark):
    df = frame(spark, [])
    assert surplus_copies(df, F.col("k"), "ts", "row_id").count() == 0
    assert keep_one(df, F.col("k"), ["ts"]).count() == 0


def test_hot_key_is_combined_before_the_shuffle(spark):
    df = spark.range(20_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit(T[0]).cast("timestamp_ntz").alias("ts"))
    kept = first_copies(df, F.col("k"), "ts", "row_id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert surplus_copies(df, F.col("k"), "ts", "row_id").count() == 6666


def test_packed_order_orders_like_the_struct(spark):
    rows = [(t, i) for t in (None, datetime(1, 1, 1), datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(9999, 12, 31)) for i in (None, -(1 << 63), -1, 0, (1 << 63) - 1)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, id bigint").withColumn("p", packed_order(F.col("ts"), F.col("id")))
    got = [(r.ts, r.id) for r in df.orderBy("p").collect()]
    high = (1 << 63) - 1
    assert [(t is None, t, high if i is None else i) for t, i in got] == sorted(((t is None, t, high if i is None else i) for t, i in rows), key=lambda x: (x[0], x[1] or T[0], x[2]))


def test_accounting_adds_up(spark):
    df = frame(spark, [(1, "a", T[0], "x", 1, ""), (2, "a", T[1], "x", 1, ""), (3, None, T[1], "x", 1, ""), (4, "a", T[1], "y", 1, "")])
    got = {r.group: (r.rows, r.messages, r.surplus) for r in copy_accounting(df, F.col("k"), "ts", "row_id", F.col("key")).collect()}
    assert got == {"x": (3, 2, 1), "y": (1, 1, 0)}


def test_surplus_counts_across_groups(spark):
    rows = [(1, "a", T[2], "x", 1, ""), (2, " A", T[1], "y", 1, ""), (3, "a", T[3], "x", 1, ""), (4, "b", T[0], "x", 1, ""), (5, "b", T[0], None, 1, ""), (6, None, T[0], "x", 1, ""), (7, None, T[0], "x", 1, "")]
    df, key = frame(spark, rows), norm_key(F.col("k"))
    got = {tuple(r) for r in surplus_accounting(df, key, "ts", "row_id", F.col("key")).collect()}
    assert got == {("x", 5, 3, 2), ("y", 1, 1, 0), (None, 1, 0, 1)}
    assert sum(r[3] for r in got) == surplus_copies(df, key, "ts", "row_id").count()


def test_payments_accounting_is_whole(spark, sf):
    from tidemill.plans import quality

    per_batch = quality.QUERIES["p1_surplus_per_batch"](spark, sf).agg(F.sum("surplus")).first()[0]
    assert per_batch == quality.QUERIES["p1_found"](spark, sf).where("table_name = 'brz_payments'").count() > quality.QUERIES["p1_copies_per_batch"](spark, sf).agg(F.sum("surplus")).first()[0]
