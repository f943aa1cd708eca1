"""Demand forecasts by a Poisson regression on past-only features, with an empirical band and recursion over horizons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.scale import written

FEATURES = ("lag_1", "lag_7", "mean_7", "mean_14", "weekday_sin", "weekday_cos", "promo")


def features(history: DataFrame, keys: Sequence[str], day: str, units: str, promo: str) -> DataFrame:
    """`history` (a gap-free daily grid) with FEATURES, all from strictly earlier rows; nulls where history is short."""
    w = W.partitionBy(*keys).orderBy(day)
    angle = F.weekday(day) * (2 * 3.141592653589793 / 7)
    log = lambda c: F.log1p(F.greatest(c, F.lit(0.0)))
    past = lambda n: F.avg(units).over(w.rowsBetween(-n, -1))
    return history.select(
        *keys,
        day,
        units,
        promo,
        log(F.lag(units, 1).over(w)).alias("lag_1"),
        log(F.lag(units, 7).over(w)).alias("lag_7"),
        log(past(7)).alias("mean_7"),
        log(past(14)).alias("mean_14"),
        F.sin(angle).alias("weekday_sin"),
        F.cos(angle).alias("weekday_cos"),
        F.col(promo).cast("double").alias("promo_d"),
        F.count("*").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("history_days"),
    ).drop(promo).withColumnRenamed("promo_d", "promo")


@dataclass(frozen=True)
class Forecaster:
    """A fitted model and the residual deciles that make its band."""

    model: GeneralizedLinearRegressionModel
    low: float
    high: float

    def predict(self, x: DataFrame) -> DataFrame:
        """Adds forecast, lower and upper: never negative, and the band always holds the point."""
        y = self.model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="__x", handleInvalid="skip").transform(x))
        point = F.greatest(F.col("prediction"), F.lit(0.0))
        scale = F.sqrt(point + 1)
        return y.withColumns({"forecast": point, "lower": F.greatest(F.lit(0.0), F.least(point, point + scale * self.low)), "upper": F.greatest(point, point + scale * self.high)}).drop("__x", "prediction")


def fit(x: DataFrame, units: str, weight: Column | None = None, least_history: int = 14) -> Forecaster:
    """Fits on rows with enough history; the band is the 10th and 90th percentile of residuals scaled by sqrt(1 + forecast)."""
    train = x.where(F.col("history_days") >= least_history).withColumn("__w", F.lit(1.0) if weight is None else weight)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="__x", handleInvalid="skip").transform(train).select("__x", "__w", units).persist()
    try:
        model = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="__x", labelCol=units, weightCol="__w", regParam=0.001, maxIter=15).fit(data)
        r = model.transform(data).select(((F.col(units) - F.col("prediction")) / F.sqrt(F.greatest("prediction", F.lit(0.0)) + 1)).alias("r"))
        low, high = r.agg(F.percentile_approx("r", F.array(F.lit(0.1), F.lit(0.9)), 10_000)).first()[0]
    finally:
        data.unpersist()
    return Forecaster(model, low, high)


def recursive(f: Forecaster, history: DataFrame, keys: Sequence[str], day: str, units: str, promo: str, horizons: int = 7) -> DataFrame:
    """Forecasts for the `horizons` days after the history's last day; each day's features use the forecasts before it.

    Only the last 15 days of a series matter, so each step works on that many rows per series; actuals after the
    origin cannot leak, as none are in the input.
    """
    last = history.agg(F.max(day)).first()[0]
    if last is None:
        raise ValueError("an empty history has no day to forecast from")
    kept = [*keys, day, units, promo]
    recent = written(history.where(F.col(day) > F.date_sub(F.lit(last), 15)).select(*keys, day, F.col(units).cast("double").alias(units), F.col(promo).cast("boolean").alias(promo)), "recent")
    series, out = recent.select(*keys).distinct(), None
    for h in range(1, horizons + 1):
        at = F.date_add(F.lit(last), h)
        tomorrow = series.select(*keys, at.alias(day), F.lit(None).cast("double").alias(units), F.lit(False).alias(promo))
        x = features(recent.unionByName(tomorrow), keys, day, units, promo).where(F.col(day) == at)
        # Written: the next step builds on it, and a plan that grew with every step would be computed over and over.
        step = written(f.predict(x).select(*keys, day, F.lit(h).alias("horizon"), "forecast", "lower", "upper"), "step")
        out = step if out is None else out.unionByName(step)
        recent = recent.unionByName(step.select(*keys, day, F.col("forecast").alias(units), F.lit(False).alias(promo)).select(*kept))
    return out


def backtest(f: Forecaster, history: DataFrame, keys: Sequence[str], day: str, units: str, promo: str, first: str, horizons: int = 7) -> DataFrame:
    """Recursive forecasts as made on the eve of every day from `first` (yyyy-MM-dd) on, for `horizons` days or up to the last day of `history`.

    keys, origin, day, horizon, units (what came), forecast, lower, upper. The origin is one more key of the series:
    each origin has its own copy of the 15 days that matter, and every step forecasts one horizon of all origins at
    once. Of the days after an origin only the planned `promo` is seen. `history` is a gap-free daily grid.
    """
    last = history.agg(F.max(day)).first()[0]
    if last is None:
        raise ValueError("an empty history has no day to forecast from")
    d, low, high = F.col(day), F.date_sub(F.lit(first).cast("date"), 1), F.date_sub(F.lit(last), 1)
    series = [*keys, "origin"]

    def copies(start: Column, end: Column, value: Column) -> DataFrame:
        spans = history.select(*keys, day, value.cast("double").alias(units), F.col(promo).cast("boolean").alias(promo), F.greatest(start, low).alias("__a"), F.least(end, high).alias("__b")).where("__a <= __b")
        return spans.select(*keys, F.explode(F.sequence("__a", "__b", F.expr("interval 1 day"))).alias("origin"), day, units, promo)

    recent = written(copies(d, F.date_add(d, 14), F.col(units)), "recent")
    ahead = written(copies(F.date_sub(d, horizons), F.date_sub(d, 1), F.lit(None)), "ahead")
    out = None
    for h in range(1, horizons + 1):
        here = F.datediff(day, "origin") == h
        x = features(recent.unionByName(ahead.where(here)), series, day, units, promo).where(here)
        # Written, as in `recursive`.
        step = written(f.predict(x).select(*series, day, F.lit(h).alias("horizon"), "forecast", "lower", "upper"), "step")
        out = step if out is None else out.unionByName(step)
        recent = recent.unionByName(step.select(*series, day, F.col("forecast").alias(units), F.lit(False).alias(promo)))
    return out.join(history.select(*keys, day, units), [*keys, day]).select(*series, day, "horizon", units, "forecast", "lower", "upper")


def permutation_importance(f: Forecaster, x: DataFrame, units: str, seed: int = 1) -> list[tuple[str, float]]:
    """(feature, rise of the mean absolute error when it is shuffled), highest first.

    A feature is shuffled by pairing rows in two hash orders inside their partitions: no global sort.
    """
    x = x.where(F.col("history_days") >= 14).dropna(subset=list(FEATURES)).persist()
    try:
        error = lambda d: f.predict(d).agg(F.avg(F.abs(F.col("forecast") - F.col(units)))).first()[0]
        base, out = error(x), []
        for i, name in enumerate(FEATURES):
            part = F.pmod(F.xxhash64(*[c for c in x.columns if c not in FEATURES], F.lit(seed + i)), F.lit(64)).alias("__p")
            a = x.select("*", part).withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy(F.xxhash64(F.struct(*x.columns), F.lit(seed)))))
            b = x.select(F.col(name).alias("__v"), part, F.struct(*x.columns).alias("__s")).withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy(F.xxhash64("__s", F.lit(seed + 1000))))).drop("__s")
            out.append((name, error(a.join(b, ["__p", "__r"]).withColumn(name, F.col("__v")).drop("__p", "__r", "__v")) - base))
        return sorted(out, key=lambda r: -r[1])
    finally:
        x.unpersist()
