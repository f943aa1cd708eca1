"""Queries that train and apply models."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.ml import forecast, segments
from tidemill.plans.marts import customer_360, daily_category_sales
from tidemill.plans.registry import Registry
from tidemill.scale import written
from tidemill.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
_VALUES = ("total_spend", "orders_completed", "recency_days", "avg_items", "weekend_share")
_KEYS = ("store_id", "category")


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    return segments.scaled(customer_360(spark, d), "customer_id", _VALUES[:4], _VALUES[4:])


@query()
def kmeans_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's segment by k-means with five groups."""
    z = written(_scaled(spark, d), "segment-features")  # read by every pass of the training
    model = KMeans(k=5, seed=7, maxIter=20).fit(z)
    return model.transform(z).select("customer_id", F.col("prediction").alias("segment"))


@query()
def silhouette_k_selection(spark: SparkSession, d: str) -> DataFrame:
    """Silhouette of three to eight segments, best first."""
    rows = [(k, round(s, 6)) for k, s, _ in segments.choose_k(written(_scaled(spark, d), "segment-features"))]
    return spark.createDataFrame(rows, "k int, silhouette double").orderBy(F.desc("silhouette"))


@query("""with c as (select label as a, cast(vec_id % 7 as int) as b, count(*) as c from embeddings group by 1, 2), r as (select a, sum(c) as c from c group by 1), k as (select b, sum(c) as c from c group by 1),
    t as (select (select sum(c) from c) as n, (select sum(c * (c - 1) / 2.0) from c) as x, (select sum(c * (c - 1) / 2.0) from r) as a, (select sum(c * (c - 1) / 2.0) from k) as b)
    select cast(n as bigint) as n, round((x - a * b / (n * (n - 1) / 2.0)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2.0)), 9) as ari from t""")
def ari_contingency(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the labels of all vectors with a second grouping, by the adjusted Rand index."""
    x = table(spark, d, "embeddings").select("label", F.pmod("vec_id", F.lit(7)).cast("int").alias("other"))
    return segments.adjusted_rand(x, "label", "other").select("n", F.round("ari", 9).alias("ari"))


@query("""with c as (select c_mktsegment as persona, c_acctbal as balance, cast(length(c_name) as double) as name_length, cast(c_nationkey as double) as nation from customer), e as (select avg(balance) as mb, stddev_samp(balance) as sb, avg(nation) as mn, stddev_samp(nation) as sn from c)
    select persona, cast(count(*) as bigint) as size, round(count(*) / sum(count(*)) over (), 4) as share, round(avg(balance), 2) as balance, round(avg(nation), 4) as nation,
      array_to_string(list_filter([case when (avg(balance) - any_value(mb)) / any_value(sb) > 0.02 then 'balance' end, case when (avg(nation) - any_value(mn)) / any_value(sn) > 0.02 then 'nation' end], lambda x: x is not null), '|') as traits from c, e group by 1""")
def segment_profile_labels(spark: SparkSession, d: str) -> DataFrame:
    """Profile and traits of given segments."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("persona"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return segments.profiles(c, "persona", ["balance", "nation"], 0.02).withColumn("balance", F.round("balance", 2))


@query()
def demand_feature_importance(spark: SparkSession, d: str) -> DataFrame:
    """How much worse the forecasts get when a feature is shuffled, most important first."""
    x = written(forecast.features(_grid(spark, d), _KEYS, "business_date", "units", "promo_active"), "features")
    model = forecast.fit(x.where("business_date < date'2001-01-01'"), "units")
    rows = forecast.permutation_importance(model, x.where("business_date >= date'2001-01-01'"), "units")
    return spark.createDataFrame([(n, round(v, 6), i) for i, (n, v) in enumerate(rows, 1)], "feature string, importance double, rank int")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return written(daily_category_sales(spark, d).select(*_KEYS, "business_date", F.col("units").cast("double").alias("units"), "promo_active"), "grid")


@query()
def demand_forecast_backtest(spark: SparkSession, d: str) -> DataFrame:
    """Poisson forecasts one to seven days ahead from every day since 2001, trained on all days before, with quality per category and horizon."""
    g = _grid(spark, d)
    x = forecast.features(g, _KEYS, "business_date", "units", "promo_active")
    model = forecast.fit(x.where("business_date < date'2001-01-01'"), "units")
    y = forecast.backtest(model, g, _KEYS, "business_date", "units", "promo_active", "2001-01-01")
    e = F.col("forecast") - F.col("units")
    return y.groupBy("category", "horizon").agg(F.count("*").alias("n"), F.round(F.sum(F.abs(e)) / F.sum("units"), 4).alias("wape"), F.round(F.sum(e) / F.sum("units"), 4).alias("bias"), F.round(F.avg((F.col("units").between(F.col("lower"), F.col("upper"))).cast("int")), 4).alias("coverage"))


@query()
def demand_forecast_future(spark: SparkSession, d: str) -> DataFrame:
    """Seven days ahead for every store and category."""
    g = _grid(spark, d)
    model = forecast.fit(forecast.features(g, _KEYS, "business_date", "units", "promo_active"), "units")
    return forecast.recursive(model, g, _KEYS, "business_date", "units", "promo_active")
