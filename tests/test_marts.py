import math
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill import serving
from tidemill.functions.expressions import poisson_low, poisson_tail
from tidemill.operators import recommend, retrieval
from tidemill.plans import marts, ops, stats
from tidemill.plans.marts import global_rank

D = date(2025, 9, 1)


def grid(spark, units, out=(), counted=None):
    rows = [("s", D + timedelta(days=i), u, i in out, (counted or {}).get(i)) for i, u in enumerate(units)]
    return spark.createDataFrame(rows, "k string, business_date date, units bigint, out boolean, counted bigint")


@pytest.mark.parametrize(
    "units, out, expected",
    [([4] * 20 + [1], [20], [(4.0, 3.0)]), ([4] * 12 + [0] + [4] * 10 + [0], [12, 23], [(4.0, 4.0), (4.0, 4.0)]), ([4, 4, 0], [2], []), ([2] * 10 + [9], [10], [(2.0, 0.0)])],
)
def test_lost_sales(spark, units, out, expected):
    got = stats.estimate_lost(grid(spark, units, out), ["k"], "units", "out").orderBy("business_date").collect()
    assert [(r.expected_units, r.lost_units) for r in got] == expected


def test_stock_follows_counts_both_ways(spark):
    df = grid(spark, [2, 3, 1, 4, 5, 1], counted={2: 10, 4: 0}).withColumn("moved", -F.col("units"))
    got = stats.rebuild_stock(df, ["k"], "moved", "counted").orderBy("business_date").collect()
    assert [r.closing for r in got] == [14, 11, 10, 6, 0, 0] and [r.opening for r in got] == [16, 14, 11, 10, 6, 0]
    assert [r.gap for r in got] == [None, None, None, None, -1, None] and [r.negative for r in got] == [False] * 5 + [True]


def test_poisson(spark):
    df = spark.createDataFrame([(k, mu) for k in (0, 1, 2, 5, 40) for mu in (0.05, 3.0, 30.0)], "k int, mu double")
    for r in df.select("k", "mu", poisson_tail(F.col("k"), F.col("mu")).alias("up"), poisson_low(F.col("k"), F.col("mu")).alias("low")).collect():
        below = sum(math.exp(-r.mu + i * math.log(r.mu) - math.lgamma(i + 1)) for i in range(r.k))
        at = math.exp(-r.mu + r.k * math.log(r.mu) - math.lgamma(r.k + 1))
        assert math.isclose(r.up, 1 - below, abs_tol=1e-12) and math.isclose(r.low, below + at, abs_tol=1e-12)


def test_global_rank(spark):
    df = spark.createDataFrame([(i, (i * 37) % 11) for i in range(200)], "i int, v int").repartition(5)
    got = {r.i: (r.rank, r.rows) for r in global_rank(df, ["v", "i"]).collect()}
    assert got == {i: (n, 200) for n, i in enumerate(sorted(range(200), key=lambda i: ((i * 37) % 11, i)), 1)}


def test_runs_merge(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 2)], "k string, i int")
    got = stats.merged_runs(df, ["k"], F.col("i"), [F.min("i").alias("a"), F.max("i").alias("b")]).collect()
    assert sorted(map(tuple, got)) == [("a", 1, 2), ("a", 4, 4), ("b", 2, 2)]


def test_ranking_metrics(spark):
    lists = spark.createDataFrame([(c, f"P{i}") for c in "AB" for i in range(10)], "customer string, product string")
    bought = spark.createDataFrame([("A", "P0"), ("A", "P1"), ("B", "X1"), ("B", "X2")], "customer string, product string")
    assert tuple(recommend.ranking_metrics(lists, bought, 20).first()) == (2, 0.1, 0.5, 0.5, 0.5)


def test_closing_is_next_opening_and_sales_add_up(spark, sf):
    x = stats.inventory_daily(spark, sf).where("store_id = 1 and category = 'PROMO'").orderBy("business_date").collect()
    assert all(a.closing == b.opening for a, b in zip(x, x[1:]))
    sales, category = marts.daily_sales(spark, sf), marts.daily_category_sales(spark, sf)
    assert sales.agg(F.sum(F.col("gmv") - F.col("discount"))).first()[0] == category.agg(F.sum("revenue")).first()[0]  # gmv is before discounts
    assert sales.count() == sales.select("store_id", "business_date").distinct().count()


def test_features_see_only_the_past(spark, sf):
    x = marts.demand_features(spark, sf).where("store_id = 1 and category = 'PROMO'").orderBy("business_date").collect()
    for i in (0, 1, 6, 20, 300):
        past = [r.units for r in x[max(0, i - 7) : i]]
        assert x[i].history_days == i and x[i].lag_1 == (x[i - 1].units if i else None) and x[i].mean_7 == (pytest.approx(sum(past) / len(past), abs=6e-4) if past else None)


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "The freezer door " * 70), (2, "refunds are paid back within five days after the counter closed for goods returned late"), (3, "short text"), (4, None)], "d int, t string")
    parts = retrieval.chunks(docs, "d", "t")
    assert sorted((r.doc_id, r.part, r.words) for r in parts.collect()) == [(1, 1, 160), (1, 2, 80), (2, 1, 15)]
    asked = spark.createDataFrame([(7, "How do I get my money back?"), (8, "zebra")], "q int, t string")
    got = retrieval.top_answers(retrieval.bm25(parts, ["doc_id", "part"], "text", asked, "q", "t"), ["doc_id", "part"], 1).collect()
    assert [(r.question_id, r.doc_id) for r in got] == [(7, 2)]
    x = spark.createDataFrame([("It rose by 1,200 to 7.5.", "from 1200 units, 7.5 percent"), ("It is 9.", "8")], "r string, e string")
    assert [r.u for r in x.select(retrieval.ungrounded(F.col("r"), F.col("e")).alias("u")).collect()] == [[], ["9"]]
    words = spark.createDataFrame([(w,) for w in ["lapsing", "detected", "categories", "stockouts", "loss", "red"]], "w string")
    assert [r.s for r in words.select(retrieval.stem(F.col("w")).alias("s")).collect()] == ["laps", "detect", "category", "stockout", "loss", "red"]


def test_reachability_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source string, target string")
    assert {tuple(r) for r in ops.reachable(e).collect()} == {("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("a", "c", 2), ("b", "d", 2), ("a", "d", 3)}
    x = spark.createDataFrame([("failed at /root/x/y.csv: C:\\data\\z 'bad'",)], "t string").select(ops.scrubbed(F.col("t")).alias("t"))
    assert x.first().t == "failed at <path> <path> 'bad'"


def test_serving_checks_roles_parameters_and_filters(spark):
    sf = "/root/testdata/sf0.001"
    with pytest.raises(serving.AccessDenied):
        serving.ask(spark, sf, "planner", "sales_kpis")
    with pytest.raises(ValueError):
        serving.ask(spark, sf, "manager", "sales_kpis", nonsense=1)
    every = serving.ask(spark, sf, "analyst", "revenue_by_store")
    two = [r.store_id for r in every.collect()][:2]
    kpis = serving.ask(spark, sf, "analyst", "sales_kpis", stores=two).where("period = 'current'").first()
    total = sum(r.net_revenue for r in every.collect() if r.store_id in two)
    assert kpis.net_revenue == total
    assert serving.one_of("c", "p", ["a'b"]) == " and array_contains(:p, c)" and serving.one_of("c", "p", []) == ""


def test_published_lists_rest_on_all_lines(spark, sf):
    lines = {(r.order, r.customer, r.product) for r in stats._lines(spark, sf, until=None).collect()}
    early = {r.customer for r in stats._lines(spark, sf).select("customer").distinct().collect()}
    everyone, orders, own = {c for _, c, _ in lines}, Counter(p for _, _, p in lines), Counter((c, p) for _, c, p in lines)
    assert everyone - early
    got = stats.QUERIES["recommend_published_topk"](spark, sf).collect()
    assert {r.customer_id for r in got} == everyone
    assert all((r.reason == "repeat") == ((r.customer_id, r.brand) in own) for r in got)
    most = {c: max(k for (x, _), k in own.items() if x == c) for c in everyone}
    for r in got:  # the score less its repeat and popularity parts is 0.6 times a co-purchase between 0 and 1
        rest = r.score - own[r.customer_id, r.brand] / most[r.customer_id] - 0.5 * orders[r.brand] / max(orders.values())
        assert -1e-4 < rest < 0.6 + 1e-4
    late = min(everyone - early)
    lists = [tuple(r) for r in serving.ask(spark, sf, "analyst", "customer_recommendations", customer=late).collect()]
    assert lists == [(r.brand, r.score, r.reason, r.rank) for r in sorted(got, key=lambda r: r.rank) if r.customer_id == late] != []


def test_timeline_holds_every_day(spark, sf):
    here = "store_id = 3 and category = 'PROMO'"
    days = {r.business_date: r for r in stats.inventory_daily(spark, sf).where(here).collect()}
    lost = {r.business_date: r.lost_units for r in stats.lost_sales(spark, sf).where(here).collect()}
    got = serving.ask(spark, sf, "planner", "explorer_timeline").collect()
    assert [tuple(r) for r in got] == [(d, r.opening, r.closing, r.units, r.gap, lost.get(d)) for d, r in sorted(days.items())]
    assert got[0].business_date < date(2001, 1, 1)
