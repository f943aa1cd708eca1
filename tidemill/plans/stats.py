"""Statistical marts: stock rebuilt from counts, lost sales, baselines, forecast quality, anomalies, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.functions.expressions import count_low, count_tail, poisson_low, poisson_tail, ratio
from tidemill.operators import recommend
from tidemill.plans.marts import CATEGORY_SQL, daily_category_sales, global_rank
from tidemill.plans.registry import Registry
from tidemill.plans.star import STAR_SQL, Star, trailing
from tidemill.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def rebuild_stock(daily: DataFrame, keys: list[str], moved: str, counted: str) -> DataFrame:
    """Stock at the end of every day of a gap-free grid from movements and occasional counts (null on other days).

    Stock is the last count plus the movements since; before the first count it is reckoned backwards from that. Adds
    closing, opening (both at least 0), gap (count minus what was reckoned; null at the first count) and negative.
    One shuffle and one sort serve all windows.
    """
    w = W.partitionBy(*keys).orderBy("business_date")
    run, whole = w.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*keys).orderBy("business_date").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = daily.withColumn("__cum", F.sum(moved).over(run))
    df = df.withColumn("__base", F.col(counted) - F.col("__cum"))
    df = df.withColumns({"__at": F.coalesce(F.last("__base", ignorenulls=True).over(run), F.first("__base", ignorenulls=True).over(whole)), "__before": F.last("__base", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))})
    stock = F.col("__cum") + F.col("__at")
    # At the opening the reckoning still rests on the count before.
    opening = F.col("__cum") - F.col(moved) + F.coalesce("__before", "__at")
    return df.withColumns({"opening": F.greatest(opening, F.lit(0)), "closing": F.greatest(stock, F.lit(0)), "negative": stock < 0, "gap": F.col(counted) - (F.col("__cum") + F.col("__before"))}).drop("__cum", "__base", "__at", "__before")


_COUNTED = "case when day(business_date) = 15 then (store_id * 37 + length(category) * 11 + month(business_date) * 53 + year(business_date)) % 400 end"
INVENTORY_SQL = f"""
    inv0 as (select store_id, category, business_date, units, cast({_COUNTED} as bigint) as counted, sum(-units) over (partition by store_id, category order by business_date) as cum from daily_category_sales),
    inv1 as (select *, last_value(counted - cum ignore nulls) over (partition by store_id, category order by business_date rows between unbounded preceding and current row) as b, last_value(counted - cum ignore nulls) over (partition by store_id, category order by business_date rows between unbounded preceding and 1 preceding) as before,
        first_value(counted - cum ignore nulls) over (partition by store_id, category order by business_date rows between unbounded preceding and unbounded following) as f from inv0),
    inventory_daily as (select store_id, category, business_date, units, counted, cast(greatest(cum + units + coalesce(before, b, f), 0) as bigint) as opening, cast(greatest(cum + coalesce(b, f), 0) as bigint) as closing, cum + coalesce(b, f) < 0 as negative, cast(counted - (cum + before) as bigint) as gap,
        cum + coalesce(b, f) <= 0 as is_stockout from inv1)"""


@query(f"with {STAR_SQL}, {CATEGORY_SQL}, {INVENTORY_SQL} select * from inventory_daily")
def inventory_daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily stock per store and category, re-anchored at monthly counts (made by a rule both engines can compute)."""
    g = daily_category_sales(spark, d).select("store_id", "category", "business_date", "units", F.expr(_COUNTED).cast("bigint").alias("counted"), (-F.col("units")).alias("moved"))
    x = rebuild_stock(g, ["store_id", "category"], "moved", "counted")
    return x.select("store_id", "category", "business_date", "units", "counted", "opening", "closing", "negative", "gap", (F.col("closing") <= 0).alias("is_stockout"))


def estimate_lost(daily: DataFrame, keys: list[str], units: str, out: str, history: int = 28, least: int = 7) -> DataFrame:
    """Expected and lost units of days out of stock: the mean of in-stock days among the `history` rows before (at least `least`)."""
    w = W.partitionBy(*keys).orderBy("business_date").rowsBetween(-history, -1)
    sold = F.when(~F.col(out), F.col(units))
    df = daily.withColumns({"__n": F.count(sold).over(w), "__s": F.sum(sold).over(w)})
    df = df.where(F.col(out) & (F.col("__n") >= least)).withColumn("__e", F.col("__s") / F.col("__n"))
    exact = lambda c: F.round(c, 3).cast("decimal(18,3)")  # noqa: E731  decimals, so that totals do not depend on the order of adding
    return df.withColumns({"expected_units": exact(F.col("__e")), "lost_units": exact(F.greatest(F.col("__e") - F.col(units), F.lit(0.0)))}).drop("__n", "__s", "__e")


@query(f"""with {STAR_SQL}, {CATEGORY_SQL}, {INVENTORY_SQL},
    h as (select *, count(case when not is_stockout then units end) over w as n, sum(case when not is_stockout then units end) over w as s from inventory_daily window w as (partition by store_id, category order by business_date rows between 28 preceding and 1 preceding))
    select store_id, category, business_date, units, cast(round(s / n, 3) as decimal(18,3)) as expected_units, cast(round(greatest(s / n - units, 0), 3) as decimal(18,3)) as lost_units from h where is_stockout and n >= 7""")
def lost_sales(spark: SparkSession, d: str) -> DataFrame:
    """What would have sold on days out of stock."""
    x = estimate_lost(inventory_daily(spark, d), ["store_id", "category"], "units", "is_stockout")
    return x.select("store_id", "category", "business_date", "units", "expected_units", "lost_units")


_SERIES = "over (partition by store_id, category order by business_date)"
_HORIZONS_SQL = " union all ".join(
    f"select store_id, category, business_date as origin_date, cast({h} as int) as horizon, business_date + {h} as forecast_date, naive_{h} as seasonal_naive, round(moving_avg, 6) as moving_avg, actual_{h} as actual_units from b" for h in range(1, 8)
)


@query(f"""with {STAR_SQL}, {CATEGORY_SQL},
    b as (select store_id, category, business_date, sum(units) over (partition by store_id, category order by business_date rows between 6 preceding and current row) / 7.0 as moving_avg,
      {", ".join(f"lag(units, {7 - h}) {_SERIES} as naive_{h}, lead(units, {h}) {_SERIES} as actual_{h}" for h in range(1, 8))} from daily_category_sales)
    select * from ({_HORIZONS_SQL}) where origin_date >= date '2001-01-01' and seasonal_naive is not null and actual_units is not null""")
def baseline_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Seasonal-naive and moving-average forecasts for seven horizons from every origin of the test year; no joins, only windows."""
    w = trailing("store_id", "category")
    g = daily_category_sales(spark, d).select("store_id", "category", "business_date", "units")
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lag("units", 7 - h).over(w).alias("seasonal_naive"), F.lead("units", h).over(w).alias("actual_units")) for h in range(1, 8)])
    x = g.select("store_id", "category", F.col("business_date").alias("origin_date"), (F.sum("units").over(w.rowsBetween(-6, 0)) / 7.0).alias("m"), each.alias("e")).where("origin_date >= date'2001-01-01'")
    x = x.select("store_id", "category", "origin_date", "m", F.explode("e").alias("e")).where("e.actual_units is not null and e.seasonal_naive is not null")
    return x.select("store_id", "category", "origin_date", "e.horizon", F.date_add("origin_date", F.col("e.horizon")).alias("forecast_date"), "e.seasonal_naive", F.round("m", 6).alias("moving_avg"), "e.actual_units")


@query("""select run_type, model_version, coalesce(category_id, 'all') as category, coalesce(cast(horizon as varchar), 'all') as horizon, cast(count(*) as bigint) as n, round(avg(abs(e)), 4) as mae, round(sqrt(avg(e * e)), 4) as rmse, round(sum(abs(e)) / nullif(sum(a), 0), 4) as wape,
      round(sum(e) / nullif(sum(a), 0), 4) as bias, round(avg(case when a between lower_units and upper_units then cast(1 as double) else cast(0 as double) end), 4) as coverage
    from (select *, actual_units as a, forecast_units - actual_units as e from gld_demand_predictions where actual_units is not null and forecast_units is not null and category_id is not null and horizon is not null)
    group by grouping sets ((run_type, model_version), (run_type, model_version, category_id), (run_type, model_version, horizon), (run_type, model_version, category_id, horizon))""")
def forecast_metrics_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """MAE, RMSE, WAPE, bias and interval coverage for all, each category, each horizon and both: one aggregation."""
    table(spark, d, "gld_demand_predictions").createOrReplaceTempView("tidemill_predictions")
    return spark.sql(SQL["forecast_metrics_grouping_sets"].replace("gld_demand_predictions", "tidemill_predictions").replace("varchar", "string"))


@query(f"""with {STAR_SQL}, {CATEGORY_SQL}, sku as (select store_id, category, product_id, sum(quantity) as units from l where is_completed and business_date > (select max(business_date) from o) - 28 group by 1, 2, 3),
    cat as (select store_id, category, sum(units) as units from sku group by 1, 2), f as (select store_id, category, sum(units) / 28.0 as forecast from daily_category_sales where business_date > (select max(business_date) from o) - 28 group by 1, 2)
    select sku.store_id, sku.product_id, round(forecast * sku.units / nullif(cat.units, 0), 6) as forecast_units, round(sku.units / cat.units, 6) as share from sku join cat using (store_id, category) join f using (store_id, category)""")
def sku_topdown_split(spark: SparkSession, d: str) -> DataFrame:
    """Category forecasts split over products by their share of the last 28 days."""
    s = Star(spark, d)
    end = F.broadcast(s.orders().agg(F.max("business_date").alias("end")))  # one row
    recent = lambda df: df.join(end).where(F.col("business_date") > F.date_sub("end", 28))
    sku = recent(s.completed_lines()).groupBy("store_id", "category", "product_id").agg(F.sum("quantity").alias("units"))
    f = recent(daily_category_sales(spark, d)).groupBy("store_id", "category").agg((F.sum("units") / 28.0).alias("forecast"))
    share = F.col("units") / F.sum("units").over(W.partitionBy("store_id", "category"))
    x = sku.withColumn("share", share).join(f, ["store_id", "category"])
    return x.select("store_id", "product_id", F.round(F.col("forecast") * F.col("share"), 6).alias("forecast_units"), F.round("share", 6).alias("share"))


# --- anomalies over the event stream --------------------------------------------------------------------------------

_LOW_SQL = "list_sum(list_transform(range(0, cast({k} as int) + 1), lambda i: exp(i * ln({mu}) - {mu} - lgamma(i + 1))))"
_UP_SQL = "greatest(0, 1 - coalesce(list_sum(list_transform(range(0, cast({k} as int)), lambda i: exp(i * ln({mu}) - {mu} - lgamma(i + 1)))), 0))"
_HOURS_SQL = """
    ends as (select cast(min(ts) as date) as a, cast(max(ts) as date) as b from events),
    counts as (select event_type, date_trunc('hour', ts) as h, count(*) as n from events group by 1, 2),
    grid as (select t.event_type, x.h, coalesce(n, 0) as n from (select distinct event_type from events) t cross join (select unnest(generate_series(cast(a as timestamp), cast(b as timestamp) + interval 23 hour, interval 1 hour)) as h from ends) x left join counts c on c.event_type = t.event_type and c.h = x.h),
    hourly as (select event_type, h, cast(n as bigint) as n, avg(n) over w as expected, count(*) over w as days from grid window w as (partition by event_type, hour(h) order by h rows between 28 preceding and 1 preceding))"""


def hourly_baseline(spark: SparkSession, d: str) -> DataFrame:
    """(event_type, h, n, expected, days): events per type and hour on a full grid, against the same hour of up to 28 days before."""
    e = table(spark, d, "events").select("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"))
    counts = e.groupBy("event_type", "h").agg(F.count("*").alias("n"))
    ends = counts.agg(F.date_trunc("day", F.min("h")).alias("a"), (F.date_trunc("day", F.max("h")) + F.expr("interval 23 hours")).alias("b"))
    grid = counts.select("event_type").distinct().join(F.broadcast(ends)).select("event_type", F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("h"))
    full = grid.join(counts, ["event_type", "h"], "left").fillna(0, ["n"])
    w = W.partitionBy("event_type", F.hour("h")).orderBy("h").rowsBetween(-28, -1)
    return full.select("event_type", "h", "n", F.avg("n").over(w).alias("expected"), F.count("*").over(w).alias("days"))


@query(f"""with {_HOURS_SQL},
    c as (select event_type, cast(h as date) as day, h, days, sum(n) over w as cn, sum(expected) over w as ce, n, expected from hourly where days >= 3 window w as (partition by event_type, cast(h as date) order by h)),
    wins as (select a.event_type, a.day, a.h as start_ts, cast(date_diff('hour', a.h, b.h) + 1 as int) as hours, cast(b.cn - a.cn + a.n as bigint) as observed, round(b.ce - a.ce + a.expected, 9) as expected from c a join c b on b.event_type = a.event_type and b.day = a.day and b.h >= a.h + interval 1 hour and b.h <= a.h + interval 7 hour),
    p as (select *, round({_LOW_SQL.format(k="observed", mu="expected")}, 9) as p from wins where expected >= 2)
    select event_type, day, start_ts, hours, observed, expected, p from (select *, row_number() over (partition by event_type, day order by p, start_ts, hours) as r from p) where r = 1 and p < 0.05""")
def outage_windows_poisson(spark: SparkSession, d: str) -> DataFrame:
    """Per event type and day the least likely quiet window of 2 to 8 hours, by the lower Poisson tail."""
    wins = _windows(hourly_baseline(spark, d).where("days >= 3").withColumn("day", F.to_date("h")), 2.0)
    p = wins.withColumn("p", F.round(poisson_low(F.col("observed"), F.col("expected")), 9))
    best = W.partitionBy("event_type", "day").orderBy("p", "start_ts", "hours")
    return p.withColumn("r", F.row_number().over(best)).where("r = 1 and p < 0.05").drop("r").withColumn("start_ts", F.col("start_ts").cast("timestamp_ntz"))


def merged_runs(df: DataFrame, keys: list[str], index: Column, aggregates: list[Column]) -> DataFrame:
    """Consecutive rows (index differing by one) of each key as one row: gaps and islands."""
    w = W.partitionBy(*keys).orderBy("__i")
    x = df.withColumn("__i", index).withColumn("__run", F.col("__i") - F.row_number().over(w))
    return x.groupBy(*keys, "__run").agg(*aggregates).drop("__run")


@query(f"""with {_HOURS_SQL}, f as (select *, round({_UP_SQL.format(k="n", mu="greatest(expected, 0.05)")}, 12) as p from hourly where event_type = 'error' and days >= 3),
    hits as (select *, date_diff('hour', timestamp '2000-01-01', h) - row_number() over (order by h) as run from f where n >= 4 and p < 0.2)
    select min(h) as start_ts, max(h) as end_ts, cast(sum(n) as bigint) as observed, round(sum(expected), 6) as expected, round(min(p), 9) as p from hits group by run""")
def failure_hours(spark: SparkSession, d: str) -> DataFrame:
    """Runs of hours with far more errors than the same hour before, by the upper Poisson tail."""
    x = hourly_baseline(spark, d).where("event_type = 'error' and days >= 3").withColumn("p", F.round(poisson_tail(F.col("n"), F.greatest("expected", F.lit(0.05))), 12)).where("n >= 4 and p < 0.2")
    hour = F.floor(F.unix_seconds("h") / 3600)
    runs = merged_runs(x, ["event_type"], hour, [F.min("h").alias("start_ts"), F.max("h").alias("end_ts"), F.sum("n").alias("observed"), F.round(F.sum("expected"), 6).alias("expected"), F.round(F.min("p"), 9).alias("p")])
    return runs.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_ts", "end_ts")], "observed", "expected", "p")


@query(f"""with {STAR_SQL}, {CATEGORY_SQL},
    t as (select *, sum(units) over (partition by store_id, business_date) as store_units from daily_category_sales),
    e as (select *, sum(units) over w / nullif(sum(store_units) over w, 0) * store_units as expected, row_number() over (partition by store_id, category order by business_date) as r from t window w as (partition by store_id, category order by business_date rows between 28 preceding and 1 preceding)),
    hits as (select *, date_diff('day', date '1990-01-01', business_date) - row_number() over (partition by store_id, category order by business_date) as run from e where r > 28 and units >= 100 and units > 3 * greatest(expected, 0.05))
    select store_id, category, min(business_date) as start_date, max(business_date) as end_date, cast(sum(units) as bigint) as observed, round(sum(greatest(expected, 0.05)), 6) as expected from hits group by store_id, category, run""")
def demand_spikes_islands(spark: SparkSession, d: str) -> DataFrame:
    """Days on which a category takes a far larger part of its store's sales than in the 28 days before; consecutive days merged."""
    day = W.partitionBy("store_id", "business_date")
    w = trailing("store_id", "category")
    t = daily_category_sales(spark, d).select("store_id", "category", "business_date", "units", F.sum("units").over(day).alias("store_units"))
    past = w.rowsBetween(-28, -1)
    expected = F.try_divide(F.sum("units").over(past), F.sum("store_units").over(past)) * F.col("store_units")
    x = t.withColumns({"expected": expected, "r": F.row_number().over(w)}).withColumn("expected", F.greatest("expected", F.lit(0.05)))
    hits = x.where("r > 28 and units >= 100 and units > 3 * expected")
    return merged_runs(hits, ["store_id", "category"], F.datediff("business_date", F.lit("1990-01-01").cast("date")), [F.min("business_date").alias("start_date"), F.max("business_date").alias("end_date"), F.sum("units").alias("observed"), F.round(F.sum("expected"), 6).alias("expected")])


@query(f"with {_HOURS_SQL} select event_type, round(greatest(sum((n - expected) * (n - expected) - n) / sum(expected * expected), 0), 9) as alpha from hourly where days >= 3 group by 1")
def nb_alpha(spark: SparkSession, d: str) -> DataFrame:
    """Over-dispersion of the hourly counts by the method of moments, at least 0; one aggregation."""
    e, n = F.col("expected"), F.col("n")
    return hourly_baseline(spark, d).where("days >= 3").groupBy("event_type").agg(F.round(F.greatest(F.sum((n - e) * (n - e) - n) / F.sum(e * e), F.lit(0.0)), 9).alias("alpha"))


# The negative binomial tails by their definition, term by term: r = 1 / alpha, p = r / (r + mu).
_NB_TERM = "exp(lgamma(i + 1 / {a}) - lgamma(i + 1) - lgamma(1 / {a}) + ln(1 / (1 + {a} * {mu})) / {a} + i * ln({a} * {mu} / (1 + {a} * {mu})))"
_NB_LOW_SQL = "case when {a} <= 1e-6 then " + _LOW_SQL + " else list_sum(list_transform(range(0, cast({k} as int) + 1), lambda i: " + _NB_TERM + ")) end"
_NB_UP_SQL = "case when {a} <= 1e-6 then " + _UP_SQL + " else greatest(0, 1 - coalesce(list_sum(list_transform(range(0, cast({k} as int)), lambda i: " + _NB_TERM + ")), 0)) end"
_ALPHA_SQL = "coalesce(greatest(sum((n - expected) * (n - expected) - n) / nullif(sum(expected * expected), 0), 0), 0)"


def dispersion(df: DataFrame, n: str, expected: str, by: list[str]) -> DataFrame:
    """(*by, alpha): over-dispersion of counts against what was expected, by the method of moments, at least 0; one row without `by`."""
    e, x = F.col(expected), F.col(n)
    alpha = F.coalesce(F.greatest(F.try_divide(F.sum((x - e) * (x - e) - x), F.sum(e * e)), F.lit(0.0)), F.lit(0.0))
    return df.groupBy(*by).agg(alpha.alias("alpha"))


@query(f"""with {_HOURS_SQL}, a as (select event_type, {_ALPHA_SQL} as alpha from hourly where days >= 3 group by 1),
    c as (select event_type, cast(h as date) as day, h, days, sum(n) over w as cn, sum(expected) over w as ce, n, expected from hourly where days >= 3 and hour(h) between 6 and 23 window w as (partition by event_type, cast(h as date) order by h)),
    wins as (select a.event_type, a.day, a.h as start_ts, cast(date_diff('hour', a.h, b.h) + 1 as int) as hours, cast(b.cn - a.cn + a.n as bigint) as observed, round(b.ce - a.ce + a.expected, 9) as expected from c a join c b on b.event_type = a.event_type and b.day = a.day and b.h >= a.h + interval 1 hour and b.h <= a.h + interval 7 hour),
    p as (select wins.*, alpha, round({_NB_LOW_SQL.format(k="observed", mu="expected", a="alpha")}, 9) as p from wins join a using (event_type) where expected >= 6)
    select event_type, day, start_ts, hours, observed, expected, round(alpha, 9) as alpha, p from (select *, row_number() over (partition by event_type, day order by p, start_ts, hours) as r from p) where r = 1 and p < 0.01""")
def outage_windows_nb(spark: SparkSession, d: str) -> DataFrame:
    """Per event type and day the least likely quiet window of 2 to 8 open hours (6 to 23), by the lower negative binomial tail."""
    hours = hourly_baseline(spark, d).where("days >= 3")
    alpha = dispersion(hours, "n", "expected", ["event_type"])
    x = hours.where(F.hour("h").between(6, 23)).withColumn("day", F.to_date("h"))
    wins = _windows(x, 6.0).join(F.broadcast(alpha), "event_type")  # one row per event type
    p = wins.withColumn("p", F.round(count_low(F.col("observed"), F.col("expected"), F.col("alpha")), 9)).withColumn("alpha", F.round("alpha", 9))
    best = W.partitionBy("event_type", "day").orderBy("p", "start_ts", "hours")
    return p.withColumn("r", F.row_number().over(best)).where("r = 1 and p < 0.01").drop("r").withColumn("start_ts", F.col("start_ts").cast("timestamp_ntz"))


def _windows(x: DataFrame, least: float) -> DataFrame:
    """Every window of 2 to 8 hours of one day with at least `least` events expected: (event_type, day, start_ts, hours, observed, expected)."""
    w = W.partitionBy("event_type", "day").orderBy("h")
    span = lambda k: w.rowsBetween(0, k - 1)
    ahead = [F.struct(F.lit(k).alias("hours"), F.sum("n").over(span(k)).alias("observed"), F.round(F.sum("expected").over(span(k)), 9).alias("expected"), F.count("*").over(span(k)).alias("whole")) for k in range(2, 9)]
    each = x.select("event_type", "day", F.col("h").alias("start_ts"), F.array(*ahead).alias("e")).select("event_type", "day", "start_ts", F.explode("e").alias("e")).select("event_type", "day", "start_ts", "e.*")
    return each.where((F.col("whole") == F.col("hours")) & (F.col("expected") >= least)).drop("whole")


_SPIKES_SQL = f"""
    t as (select *, sum(units) over (partition by store_id, business_date) as store_units from daily_category_sales),
    e as (select *, greatest(coalesce(sum(units) over w / nullif(sum(store_units) over w, 0) * store_units, 0), 0.05) as expected, row_number() over (partition by store_id, category order by business_date) as r from t window w as (partition by store_id, category order by business_date rows between 28 preceding and 1 preceding)),
    cells as (select store_id, category, business_date, units as n, round(expected, 9) as expected from e where r > 28),
    alpha as (select {_ALPHA_SQL} as alpha from cells),
    spiked as (select store_id, category, business_date, n, expected, round({_NB_UP_SQL.format(k="n", mu="expected", a="alpha")}, 12) as p from cells, alpha where n >= 4 and n > 3 * expected),
    runs as (select *, date_diff('day', date '1990-01-01', business_date) - row_number() over (partition by store_id, category order by business_date) as run from spiked where p < 0.001),
    spikes as (select store_id, category, min(business_date) as start_date, max(business_date) as end_date, cast(sum(n) as bigint) as observed, round(sum(expected), 6) as expected, min(p) as p from runs group by store_id, category, run)"""
_SEVERITY_SQL = "round(least(-log10(greatest(p, 1e-20)), 20), 4) as score, case when least(-log10(greatest(p, 1e-20)), 20) >= 8 then 'High' else 'Medium' end as severity"


@query(f"""with {STAR_SQL}, {CATEGORY_SQL}, {_SPIKES_SQL}
    select 'spike-' || lpad(cast(row_number() over (order by start_date, store_id, category) as varchar), 5, '0') as anomaly_id, *, {_SEVERITY_SQL} from spikes""")
def demand_spikes_nb(spark: SparkSession, d: str) -> DataFrame:
    """Days on which a category's part of its store's sales is improbably large (upper negative binomial tail), consecutive days merged, with id, score and severity."""
    return numbered(spikes(spark, d), "spike", ["start_date", "store_id", "category"])


def spikes(spark: SparkSession, d: str) -> DataFrame:
    t = daily_category_sales(spark, d).select("store_id", "category", "business_date", "units", F.sum("units").over(W.partitionBy("store_id", "business_date")).alias("store_units"))
    w = trailing("store_id", "category")
    past = w.rowsBetween(-28, -1)
    expected = F.greatest(F.coalesce(F.try_divide(F.sum("units").over(past), F.sum("store_units").over(past)) * F.col("store_units"), F.lit(0.0)), F.lit(0.05))
    cells = t.select("store_id", "category", "business_date", F.col("units").alias("n"), F.round(expected, 9).alias("expected"), F.row_number().over(w).alias("r")).where("r > 28").drop("r")
    alpha = F.broadcast(dispersion(cells, "n", "expected", []))  # one row
    p = F.round(count_tail(F.col("n"), F.col("expected"), F.col("alpha")), 12)
    hits = cells.where("n >= 4 and n > 3 * expected").join(alpha).withColumn("p", p).where("p < 0.001")
    return merged_runs(hits, ["store_id", "category"], F.datediff("business_date", F.lit("1990-01-01").cast("date")), [F.min("business_date").alias("start_date"), F.max("business_date").alias("end_date"), F.sum("n").alias("observed"), F.round(F.sum("expected"), 6).alias("expected"), F.min("p").alias("p")])


def numbered(found: DataFrame, kind: str, order: list[str]) -> DataFrame:
    """Anomalies with id (kind and rank by `order`), score (-log10 p, at most 20) and severity (High from 8 on)."""
    score = F.least(-F.log10(F.greatest("p", F.lit(1e-20))), F.lit(20.0))
    ranked = global_rank(found, order).withColumn("anomaly_id", F.concat(F.lit(f"{kind}-"), F.lpad(F.col("rank").cast("string"), 5, "0")))
    return ranked.drop("rank", "rows").withColumns({"score": F.round(score, 4), "severity": F.when(score >= 8, "High").otherwise("Medium")})


@query(f"""with {STAR_SQL}, {CATEGORY_SQL}, {_SPIKES_SQL}, ids as (select 'spike-' || lpad(cast(row_number() over (order by start_date, store_id, category) as varchar), 5, '0') as anomaly_id, * from spikes)
    select anomaly_id, c.business_date as day, n as observed, round(c.expected, 6) as expected, c.business_date between start_date and end_date as inside from ids join cells c using (store_id, category) where c.business_date between start_date - 14 and end_date + 14""")
def anomaly_series(spark: SparkSession, d: str) -> DataFrame:
    """The days around each spike, 14 to either side, with what was expected: an interval join by exploded days."""
    found = demand_spikes_nb(spark, d).select("anomaly_id", "store_id", "category", "start_date", "end_date")
    days = found.select("*", F.explode(F.sequence(F.date_sub("start_date", 14), F.date_add("end_date", 14), F.expr("interval 1 day"))).alias("day"))
    t = daily_category_sales(spark, d).select("store_id", "category", F.col("business_date").alias("day"), "units", F.sum("units").over(W.partitionBy("store_id", "business_date")).alias("store_units"))
    w = W.partitionBy("store_id", "category").orderBy("day")
    past = w.rowsBetween(-28, -1)
    expected = F.greatest(F.coalesce(F.try_divide(F.sum("units").over(past), F.sum("store_units").over(past)) * F.col("store_units"), F.lit(0.0)), F.lit(0.05))
    cells = t.select("store_id", "category", "day", F.col("units").alias("observed"), F.round(F.round(expected, 9), 6).alias("expected"), F.row_number().over(w).alias("r")).where("r > 28")
    return days.join(cells, ["store_id", "category", "day"]).select("anomaly_id", "day", "observed", "expected", F.col("day").between(F.col("start_date"), F.col("end_date")).alias("inside"))


# Trailing and leading windows over rows of a gap-free grid.
@query(f"""with {STAR_SQL}, {CATEGORY_SQL} select store_id, category, business_date, round(case when count(units) over w >= 7 then stddev_samp(units) over w end, 6) as std_28,
      max(units) over (partition by store_id, category order by business_date rows between 1 following and 3 following) as most_next_3 from daily_category_sales window w as (partition by store_id, category order by business_date rows between 27 preceding and current row)""")
def spread_and_outlook(spark: SparkSession, d: str) -> DataFrame:
    """Deviation of the last 28 days including today (from 7 days on), and the highest of the next three days."""
    w = trailing("store_id", "category")
    month = w.rowsBetween(-27, 0)
    std = F.when(F.count("units").over(month) >= 7, F.stddev_samp("units").over(month))
    return daily_category_sales(spark, d).select("store_id", "category", "business_date", F.round(std, 6).alias("std_28"), F.max("units").over(w.rowsBetween(1, 3)).alias("most_next_3"))


@query(f"""with {STAR_SQL}, {CATEGORY_SQL}, g as (select *, isodow(business_date) >= 6 as weekend from daily_category_sales)
    select a.store_id, a.category, a.business_date, cast(count(b.units) as int) as days, round(case when count(b.units) >= 3 then avg(b.units) end, 6) as same_kind_mean from g a left join g b on b.store_id = a.store_id and b.category = a.category and b.weekend = a.weekend and b.business_date between a.business_date - 28 and a.business_date - 1 where a.business_date >= date '2001-01-01' group by 1, 2, 3""")
def same_day_type_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the days of the same kind (working day or weekend) in the 28 calendar days before, from three on: a range frame per kind."""
    g = daily_category_sales(spark, d).select("store_id", "category", "business_date", "units", (F.weekday("business_date") >= 5).alias("weekend"))
    w = W.partitionBy("store_id", "category", "weekend").orderBy(F.datediff("business_date", F.lit("1970-01-01").cast("date"))).rangeBetween(-28, -1)
    n = F.count("units").over(w)
    return g.select("store_id", "category", "business_date", n.cast("int").alias("days"), F.round(F.when(n >= 3, F.avg("units").over(w)), 6).alias("same_kind_mean")).where("business_date >= date'2001-01-01'")


# --- recommendations ------------------------------------------------------------------------------------------------

_CUT = "1999-12-31"
_RECOMMEND_SQL = f"""
    held as (select distinct order_id, customer_id, brand from l where is_completed and business_date <= date '{_CUT}'),
    ord as (select brand, count(distinct order_id) as n from held group by 1), own as (select customer_id, brand, count(*) as k from held group by 1, 2),
    rep as (select customer_id, brand, k / max(k) over (partition by customer_id) as repeat from own),
    co as (select a.brand, b.brand as partner, count(*) as c from held a join held b on a.order_id = b.order_id and a.brand <> b.brand group by 1, 2),
    st as (select co.brand, partner, c / sqrt(n) as s from co join ord on ord.brand = partner),
    best as (select * from (select *, row_number() over (partition by brand order by s desc, partner) as r from st) where r <= 30),
    reached as (select customer_id, partner as brand, round(sum(s), 9) as s from own join best using (brand) group by 1, 2),
    near as (select customer_id, brand, s / max(s) over (partition by customer_id) as copurchase from (select *, row_number() over (partition by customer_id order by s desc, brand) as r from reached) where r <= 50),
    top as (select brand from ord order by n desc, brand limit 30),
    cand as (select customer_id, brand from rep union select customer_id, brand from near union select customer_id, brand from (select distinct customer_id from held) cross join top),
    sig as (select customer_id, brand, round(coalesce(repeat, 0), 9) as repeat, round(coalesce(copurchase, 0), 9) as copurchase, round(n / (select max(n) from ord), 9) as popular from cand left join rep using (customer_id, brand) left join near using (customer_id, brand) join ord using (brand)),
    sc as (select *, round(repeat * 1.0 + copurchase * 0.6 + popular * 0.5, 4) as score from sig),
    rec as (select customer_id, brand, score, case when repeat > 0 then 'repeat' when copurchase > 0 then 'copurchase' else 'popular' end as reason, cast(row_number() over (partition by customer_id order by score desc, brand) as int) as rank from sc qualify rank <= 10)"""


#: The same over all completed lines: the cut serves the backtest only.
_PUBLISHED_SQL = _RECOMMEND_SQL.replace(f" and business_date <= date '{_CUT}'", "")


def _lines(spark: SparkSession, d: str, until: bool | None = True) -> DataFrame:
    """Completed lines up to the cut, after it (False) or all of them (None)."""
    x = Star(spark, d).completed_lines()
    if until is not None:
        x = x.where(f"business_date {'<=' if until else '>'} date'{_CUT}'")
    return x.select(F.col("order_id").alias("order"), F.col("customer_id").alias("customer"), F.col("brand").alias("product"))


@query(f"with {STAR_SQL}, {_RECOMMEND_SQL} select * from rec")
def recommend_hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """The lists of the backtest: ten brands for every customer up to the cut, from repeats, co-purchase and popularity until then."""
    return _topk(_lines(spark, d))


@query(f"with {STAR_SQL}, {_PUBLISHED_SQL} select * from rec")
def recommend_published_topk(spark: SparkSession, d: str) -> DataFrame:
    """The published lists: ten brands for every customer with completed orders, from all of these."""
    return _topk(_lines(spark, d, until=None))


def _topk(lines: DataFrame) -> DataFrame:
    r = recommend.ranked(recommend.signals(lines))
    return r.select(F.col("customer").alias("customer_id"), F.col("product").alias("brand"), "score", "reason", "rank")


@query(f"""with {STAR_SQL}, {_RECOMMEND_SQL}, truth as (select distinct customer_id, brand from l where is_completed and business_date > date '{_CUT}'),
    per as (select customer_id, count(*) as t, count(rec.brand) as h from truth left join rec using (customer_id, brand) where customer_id in (select customer_id from rec) group by 1)
    select cast(count(*) as bigint) as customers, round(avg(h / 10), 4) as precision, round(avg(h / t), 4) as recall, round(avg(case when h > 0 then 1.0 else 0.0 end), 4) as hit_rate, round((select count(distinct brand) from rec) / 25, 4) as coverage from per""")
def recommendation_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How well the lists of the backtest meet what was bought afterwards."""
    return recommend.ranking_metrics(recommend.ranked(recommend.signals(_lines(spark, d))), _lines(spark, d, until=False), 25)


_GRID = [(a, b, c) for a in (0.0, 0.5, 1.0) for b in (0.0, 0.3, 0.6, 1.0) for c in (0.2, 0.5, 1.0, 2.0)]
_GRID_SQL = ", ".join(f"({i}, cast({a} as double), cast({b} as double), cast({c} as double))" for i, (a, b, c) in enumerate(_GRID))


@query(f"""with {STAR_SQL}, {_RECOMMEND_SQL}, truth as (select distinct customer_id, brand from l where is_completed and business_date > date '{_CUT}'), sizes as (select customer_id, count(*) as t from truth group by 1),
    g(g, wr, wc, wp) as (values {_GRID_SQL}), ranked as (select g.*, customer_id, brand, row_number() over (partition by g, customer_id order by round(repeat * wr + copurchase * wc + popular * wp, 4) desc, brand) as r from sig, g),
    h as (select g, wr, wc, wp, ranked.customer_id, any_value(t) as t, count(truth.brand) as h from ranked join sizes using (customer_id) left join truth on truth.customer_id = ranked.customer_id and truth.brand = ranked.brand where r <= 10 group by 1, 2, 3, 4, 5)
    select wr, wc, wp, round(avg(h / 10), 6) as precision, round(avg(h / t), 6) as recall from h group by g, wr, wc, wp""")
def recommendation_weights(spark: SparkSession, d: str) -> DataFrame:
    """A grid of weightings, best first."""
    return recommend.choose_weights(recommend.signals(_lines(spark, d)), _lines(spark, d, until=False), 25, _GRID)


_SHOP_LINES_SQL = """l as (select distinct upper(trim(i.order_id)) as order_id, upper(trim(o.customer_id)) as customer_id, upper(trim(i.product_id)) as brand, true as is_completed from slv_order_items i
      join (select distinct order_id, customer_id from slv_orders where lower(trim(status)) = 'delivered') o on upper(trim(o.order_id)) = upper(trim(i.order_id)) where i.product_id is not null and o.customer_id is not null)"""


@query(f"with {_SHOP_LINES_SQL}, {_PUBLISHED_SQL} select customer_id, brand as product_id, score, reason, rank from rec")
def recommend_products_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten products for every customer of the shop with delivered orders."""
    key = lambda c: F.upper(F.trim(F.col(c)))
    orders = table(spark, d, "slv_orders").where("lower(trim(status)) = 'delivered'").select(key("order_id").alias("order"), key("customer_id").alias("customer")).where("order is not null and customer is not null").distinct()
    items = table(spark, d, "slv_order_items").select(key("order_id").alias("order"), key("product_id").alias("product")).where("order is not null and product is not null")
    return _topk(items.join(orders, "order")).withColumnRenamed("brand", "product_id")
