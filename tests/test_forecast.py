from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.ml import forecast

D = date(2025, 1, 1)
KEYS = ("store", "category")


def test_backtest_equals_recursion_from_each_day(spark):
    days, first = 60, 50
    rows = [(s, c, D + timedelta(days=i), float((i * 7 + s * 3 + len(c)) % 11 + (i % 7)), False) for s in (1, 2) for c in ("A", "BB") for i in range(days)]
    history = spark.createDataFrame(rows, "store int, category string, day date, units double, promo boolean")
    f = forecast.fit(forecast.features(history, KEYS, "day", "units", "promo").where(F.col("day") < D + timedelta(days=first)), "units")
    got = {(r.store, r.category, r.origin, r.day): r for r in forecast.backtest(f, history, KEYS, "day", "units", "promo", str(D + timedelta(days=first))).collect()}
    assert len(got) == 4 * sum(min(7, days - i) for i in range(first, days))
    assert all(r.horizon == (r.day - r.origin).days for r in got.values())
    actual = {(s, c, d): u for s, c, d, u, _ in rows}
    assert all(r.units == actual[s, c, d] for (s, c, _, d), r in got.items())
    for i in (first - 1, first + 3, days - 2):  # forecasts from a history that ends at the origin
        origin = D + timedelta(days=i)
        alone = forecast.recursive(f, history.where(F.col("day") <= origin), KEYS, "day", "units", "promo").collect()
        same = [(r, got[r.store, r.category, origin, r.day]) for r in alone if r.day < D + timedelta(days=days)]
        assert len(same) == 4 * min(7, days - 1 - i)
        for a, b in same:
            assert (a.forecast, a.lower, a.upper) == pytest.approx((b.forecast, b.lower, b.upper), rel=1e-9)
