from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemill.operators.rolling import check_moving_average, daily_values, dense_days, rolling_totals

D = date(2025, 5, 1)
day = lambda n: D + timedelta(days=n)


def test_totals_count_empty_days_as_zero(spark):
    rows = [("s", day(0), 7.0), ("s", day(3), 14.0), ("s", day(3), 0.0), ("s", day(40), None), ("t", day(2), 1.0), (None, day(2), 3.0), ("s", None, 9.0)]
    df = spark.createDataFrame(rows, "e string, d date, v double")
    daily = daily_values(df, ["e"], "d", {"v": F.sum("v")})
    got = {(r.e, r.d): (r.v_sum_7, r.v_avg_7, r.v_sum_30) for r in rolling_totals(daily, ["e"], "d", {"v": "v"}).collect()}
    assert len(got) == 41 + 1 + 1
    expected = {0: 7.0, 3: 14.0}
    for n in range(41):
        s7 = sum(expected.get(k, 0) for k in range(n - 6, n + 1))
        assert got["s", day(n)] == (s7, s7 / 7, sum(expected.get(k, 0) for k in range(n - 29, n + 1)))
    assert got[None, day(2)][0] == 3.0


def test_given_calendar_and_no_extra_shuffle(spark):
    df = spark.createDataFrame([("s", day(2), 1), ("t", day(9), 5)], "e string, d date, v int")
    full = dense_days(df, ["e"], "d", ["v"], F.lit(day(0)), F.lit(day(4)))
    assert {(r.e, r.d, r.v) for r in full.collect()} == {("s", day(n), 1 if n == 2 else None) for n in range(5)}
    plan = rolling_totals(df.repartition(4), ["e"], "d", {"v": "v"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_wrong_averages(spark):
    rows = [
        ("s", day(1), day(0), 7.0, 0.0),  # right: nothing before
        ("s", day(2), day(1), 14.0, 1.0),  # right: 7 / 7
        ("s", day(3), day(2), None, 2.0),  # wrong: 21 / 7
        ("s", day(3), day(2), None, 3.005),  # within the tolerance
        ("s", day(9), day(8), 1.0, 2.0),  # wrong: only day 2 of the last seven, 14 / 7 = 2 -> right
        ("s", day(9), day(9), 1.0, None),  # no claim
        ("t", day(2), day(1), 14.0, 1.0),  # wrong: another entity
    ]
    df = spark.createDataFrame(rows, "s string, f date, o date, actual double, claimed double")
    got = {(r.s, r.o, r.claimed, r.recomputed) for r in check_moving_average(df, ["s"], "f", "o", "actual", "claimed").collect()}
    assert got == {("s", day(2), 2.0, 3.0), ("t", day(1), 1.0, 0.0)}
    assert check_moving_average(df.limit(0), ["s"], "f", "o", "actual", "claimed").count() == 0


def test_every_delivery_measure_is_rolled(spark, sf):
    from tidemill.plans import quality
    from tidemill.sources.tables import table

    measures = ("deliveries", "delivered", "failed", "cancelled_in_transit", "active_partners")
    days = {}
    for r in table(spark, sf, "gld_delivery_metrics").where("store_id is not null and business_date is not null").collect():
        at = days.setdefault((r.store_id.strip(" ").upper(), r.business_date), [None] * len(measures))
        for i, m in enumerate(measures):
            at[i] = r[m] if at[i] is None or (r[m] is not None and r[m] > at[i]) else at[i]
    got = quality.QUERIES["p2_rolling_delivery_measures"](spark, sf).collect()
    dates = sorted({d for _, d in days})
    assert len(got) == len({s for s, _ in days}) * ((dates[-1] - dates[0]).days + 1)
    for r in got[::7]:
        for p in (7, 30):
            past = [days.get((r.store_id, r.business_date - timedelta(days=i)), [0] * len(measures)) for i in range(p)]
            for i, m in enumerate(measures):
                total = sum(v[i] or 0 for v in past)
                assert r[f"{m}_sum_{p}"] == total and abs(r[f"{m}_avg_{p}"] - total / p) < 1e-6
