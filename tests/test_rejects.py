import pytest
from pyspark.sql import functions as F

from tidemill.operators.rejects import Cell, cells, instant, rejected_rows, strict_load
from tidemill.plans.quality import LAYOUTS

ROWS = [
    ("application_logs", 'LOG000000001,2025-04-05T21:11:49Z,payment-service,debug,"a, ""b"" c"', None),
    ("application_logs", ' LOG000000001 ,05/04/2025 21:11:49,"payment-service",INFO, x"y ', None),
    ("application_logs", 'LOG000000001,2025-04-05T21:11:49Z,payment-service,INFO,"open', "quoting"),
    ("application_logs", 'LOG000000001,2025-04-05T21:11:49Z,payment-service,INFO,"a" ', "quoting"),
    ("application_logs", 'LOG000000001,"2025"x,payment-service', "quoting"),
    ("application_logs", "LOG000000001,2025-04-05T21:11:49Z", "column_count"),
    ("application_logs", "", "column_count"),
    ("application_logs", None, "column_count"),
    ("application_logs", ",2025-04-05T21:11:49Z,payment-service,INFO,x", "invalid_value"),
    ("application_logs", "LOG000000001,2025-02-30T21:11:49Z,payment-service,INFO,x", "invalid_value"),
    ("application_logs", "LOG000000001,2025-04-05T21:11:49Z,payment-service,INFO,  ", "invalid_value"),
    ("application_logs", 'LOG000000001,2025-04-05T21:11:49Z,payment-service,INFO,""', "invalid_value"),
    ("application_logs", "LOG000000001\n,2025-04-05T21:11:49Z,payment-service,INFO,x", "invalid_value"),
    ("application_logs", "LOG000000001,2025-04-05T21:11:49Z,Payment-Service,INFO,x", "invalid_value"),
    ("application_logs", 'LOG000000001,2025-04-05T21:11:49Z,payment-service,INFO,"' + '""' * 100_000 + '"', None),
    ("application_logs", "LOG000000001,2025-04-05T21:11:49Z,payment-service,INFO," + "x" * 1_000_000, None),
    ("application_logs", "," * 200_000, "column_count"),
    ("inventory_events", "IE000000001,S000001,P0001,Restock,-2147483648,2025/04/05 00:00:00", None),
    ("inventory_events", "IE000000001,S000001,P0001,Restock,+0000000000000012,2025-04-05 00:00:00", None),
    ("inventory_events", "IE000000001,S000001,P0001,Restock,2147483648,2025/04/05 00:00:00", "invalid_value"),
    ("inventory_events", "IE000000001,S000001,P0001,Restock,1.0,2025/04/05 00:00:00", "invalid_value"),
    ("inventory_events", "IE000000001,S000001,P0001,Restock,1,2025/04/05 24:00:00", "invalid_value"),
    ("unknown", "a,b", "column_count"),
    (None, '"a', "quoting"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, d, t, 9, "r") for i, (d, t, _) in enumerate(ROWS)], "line_id bigint, dataset string, _corrupt_record string, line_no int, reason string")
    got = {r.line_id: r.reason for r in rejected_rows(df, LAYOUTS).collect()}
    assert got == {i: why for i, (_, _, why) in enumerate(ROWS) if why}
    assert rejected_rows(df.limit(0), LAYOUTS).count() == 0


def test_every_row_is_loaded_or_rejected(spark, sf):
    raw = spark.read.parquet(f"{sf}/landing_rows.parquet")
    loaded = sum(strict_load(raw.where(F.col("dataset") == d), layout, "_corrupt_record", "line_id").count() for d, layout in LAYOUTS.items())
    assert loaded + rejected_rows(raw, LAYOUTS).count() == raw.count()


@pytest.mark.parametrize("text, expected", [("2025-02-28 23:59:59", True), ("2024-02-29T00:00:00+00:00", True), ("2025-02-29 00:00:00", False), ("2025-13-01 00:00:00", False), ("2025-01-01 00:00:60", False), ("0000-01-01 00:00:00", False), ("2025-1-01 00:00:00", False), ("31/04/2025 00:00:00", False), ("2025-01-01 00:00:00\n", False)])
def test_instants(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(instant(F.col("t")).isNotNull().alias("ok")).first().ok is expected


def test_typed_cells(spark):
    df = spark.createDataFrame([(1, 'a, "" ,3'), (2, ',"x""y",')], "i int, t string")
    assert {r.i: r.c for r in df.select("i", cells(F.col("t")).alias("c")).collect()} == {1: ["a", '""', "3"], 2: ["", 'x"y', ""]}
    got = strict_load(df, [Cell("a"), Cell("i2", values=('""',)), Cell("n", "int")], "t", "i").collect()
    assert [tuple(r) for r in got] == [(1, "a", '""', 3)]
