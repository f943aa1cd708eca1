import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemill.operators.profile import Profiled, column_profile, load_drift, load_quantiles, remarkable

COLUMNS = [Profiled("code", pattern=r"C\d", dominance=False), Profiled("size", low=1, high=100), Profiled("price", low=0.01, high=5000), Profiled("big")]
SCHEMA = "load string, code string, size int, price decimal(12,2), big bigint, c string, lid int"


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(5)
    rows = []
    for load in ("l1", "l2", "l3", None):
        for _ in range(r.randint(150, 300)):
            code = r.choice(["C1", "C2", "c1", "", None, "C1\n", "C9" * 500]) if load == "l2" else r.choice(["C1", "C2", "C3", None])
            size = None if load == "l3" and r.random() < 0.4 else r.randint(-20, 30) if load == "l2" else r.randint(1, 10)
            rows.append((load, code, size, r.choice([None, 5, 7]) if load == "l1" else r.randint(1, 400), (1 << 60) + r.randint(0, 3), "x", 1))
    return rows, spark.createDataFrame(spark.createDataFrame(rows, SCHEMA.replace("decimal(12,2)", "int")).selectExpr("load", "code", "size", "cast(price as decimal(12,2)) price", "big", "c", "lid").collect(), SCHEMA).repartition(5)


def values(rows, k):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r[k + 1])
    return out


def test_measures(data):
    rows, df = data
    got = {(r.load, r.column_name): r for r in column_profile(df, "load", COLUMNS).collect()}
    assert len(got) == 16
    for k, p in enumerate(COLUMNS):
        for load, vs in values(rows, k).items():
            r, full = got[load, p.name], [v for v in vs if v is not None]
            assert (r.rows, r.filled, r.distinct) == (len(vs), len(full), len(set(full)))
            assert math.isclose(r.top_share, max(Counter(full).values()) / len(full))
            if p.pattern:
                assert math.isclose(r.odd_share, sum(v not in {f"C{i}" for i in range(10)} for v in full) / len(full))
            elif p.low is not None:
                inside = [v for v in full if p.low <= v <= p.high]
                assert math.isclose(r.inside_mean, sum(inside) / len(inside)) and math.isclose(r.odd_share, 1 - len(inside) / len(full), abs_tol=1e-12)


def test_remarkable(data):
    _, df = data
    got = {(r.load, r.column_name, r.aspect) for r in remarkable(column_profile(df, "load", COLUMNS), COLUMNS).collect()}
    assert {("l2", "code", "pattern"), ("l3", "size", "nulls"), ("l1", "price", "distribution"), ("l2", "size", "range")} <= got
    assert ("l1", "code", "dominance") not in got and all(x[0] for x in got)


def test_quantiles_and_drift_are_exact(data, spark):
    rows, df = data
    at = (0.0, 0.1, 0.5, 0.9, 1.0)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    got = {(r.load, r.column_name, r.q): r.value for r in load_quantiles(df, "load", COLUMNS, at).collect()}
    for k, p in enumerate(COLUMNS):
        for load, vs in values(rows, k).items():
            full = sorted(v for v in vs if v is not None)
            for q in at:
                v = full[max(1, math.ceil(q * len(full) - 1e-9)) - 1]
                assert got[load, p.name, q] == (v if p.pattern else str(v) if p.name == "big" else str(float(v)))
    drift = {(r.load, r.column_name): (r.previous, r.ks) for r in load_drift(df, "load", COLUMNS).collect()}
    assert len(drift) == 8
    for k, p in enumerate(COLUMNS):
        by = values(rows, k)
        for one, two in (("l1", "l2"), ("l2", "l3")):
            a, b = ([v for v in by[x] if v is not None] for x in (one, two))
            ks = max(abs(sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b)) for x in {*a, *b})
            previous, d = drift[two, p.name]
            assert previous == one and math.isclose(d, ks, abs_tol=1e-8)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_and_all_null(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert column_profile(none, "load", COLUMNS).count() == 0 and load_drift(none, "load", COLUMNS).count() == 0 and load_quantiles(none, "load", COLUMNS).count() == 0
    df = spark.createDataFrame([("l", None, None, None, None, None, None)] * 3, SCHEMA)
    assert {(r.null_share, r.distinct, r.top_share) for r in column_profile(df, "load", COLUMNS).collect()} == {(1.0, 0, None)}
    assert remarkable(column_profile(df, "load", COLUMNS), COLUMNS).count() == 0


def test_small_batches_carry_over(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [("a" if i % 3 else "b", None, (i * 7) % 11, None, None, None, None) for i in range(60)]
        df = spark.createDataFrame(rows, SCHEMA)
        a, b = ([r[2] for r in rows if r[0] == x] for x in "ab")
        ks = max(abs(sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b)) for x in range(11))
        assert [math.isclose(r.ks, ks, abs_tol=1e-8) for r in load_drift(df, "load", [Profiled("size")]).collect()] == [True]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
