"""Queries that generate: allocations, draws, planted faults over the star's dimensions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.operators import generate as g
from tidemill.plans.marts import CATEGORY_SQL, daily_category_sales
from tidemill.plans.registry import Registry
from tidemill.plans.star import STAR_SQL, Star
from tidemill.scale import shared_dir
from tidemill.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
_U = "cast('0x' || substr(md5({0}), 1, 8) as bigint) / 4294967296.0"


@query("""with w as (select c_nationkey as store_id, count(*) as weight from customer group by 1), e as (select *, round(weight * 1000000 / sum(weight) over (), 9) as e from w), f as (select *, floor(e) as f from e)
    select store_id, weight, cast(f + case when row_number() over (order by round(e - f, 9) desc, store_id) <= round(sum(e) over ()) - sum(f) over () then 1 else 0 end as bigint) as units from f""")
def largest_remainder_allocation(spark: SparkSession, d: str) -> DataFrame:
    """A million units shared out over stores by their customers, adding up exactly."""
    w = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("store_id")).agg(F.count("*").alias("weight"))
    return g.largest_remainder(w, "weight", 1_000_000, "store_id")


@query(f"""with c as (select n_nationkey as store, sum(n_nationkey + 1) over (order by n_nationkey) / cast(sum(n_nationkey + 1) over () as double) as c from nation), u as (select c_custkey, {_U.format("'draw|' || c_custkey")} as u from customer)
    select store, cast(count(*) as bigint) as n from (select c_custkey, min(store) as store from u join c on c.c > u.u group by 1) group by 1""")
def inverse_cdf_draws(spark: SparkSession, d: str) -> DataFrame:
    """One store drawn for every customer with weights, reproducibly."""
    choices = table(spark, d, "nation").select(F.col("n_nationkey").alias("store"), (F.col("n_nationkey") + 1).alias("weight"))
    rows = table(spark, d, "customer").select("c_custkey")
    return g.drawn(rows, choices, "store", "weight", g.uniform("draw", F.col("c_custkey"))).groupBy("store").agg(F.count("*").alias("n"))


@query(f"""with u as (select o_orderkey as order_id, o_totalprice as total, {_U.format("'faults|' || o_orderkey")} as u from orders)
    select fault, cast(count(*) as bigint) as n, cast(count(total) as bigint) as filled, cast(count(*) filter (total < 0) as bigint) as negative from (select case when u < 0.02 then 'missing' when u < 0.03 then 'negative' end as fault, case when u < 0.02 then null when u < 0.03 then -total else total end as total from u) group by 1""")
def planted_faults(spark: SparkSession, d: str) -> DataFrame:
    """Orders with planted faults, counted by kind."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("total"))
    x = g.with_faults(o, "order_id", {"missing": (0.02, {"total": F.lit(None)}), "negative": (0.01, {"total": -F.col("total")})})
    return x.groupBy("fault").agg(F.count("*").alias("n"), F.count("total").alias("filled"), F.count_if(F.col("total") < 0).alias("negative"))


@query(f"""with o as (select c_nationkey, cast(o_orderdate as date) as d, o_orderkey, o_totalprice from orders join customer on c_custkey = o_custkey), p as (select *, date '1996-01-01' + cast(length(category) * 37 as int) as s from (select distinct p_type as category from part))
    select cast(count(*) as bigint) as orders, cast(count(distinct category) as bigint) as promotions from (select o_orderkey, category, row_number() over (partition by o_orderkey order by category) as n from o join p on d between s and s + 29) where n = 1""")
def best_promotion_per_order(spark: SparkSession, d: str) -> DataFrame:
    """The first promotion in force on each order's day: an interval join by exploded days, then one per order."""
    s = Star(spark, d)
    days = s.promotions().select("category", F.explode(F.sequence("start_date", "end_date", F.expr("interval 1 day"))).alias("business_date"))
    first = s.orders().select("order_id", "business_date").join(days, "business_date").groupBy("order_id").agg(F.min("category").alias("category"))
    return first.agg(F.count("*").alias("orders"), F.count_distinct("category").alias("promotions"))


@query(f"""with {STAR_SQL}, w as (select order_id, store_id, business_date, 1 + floor({_U.format("'size|' || order_id")} * 6) as weight, 3 * count(*) over (partition by store_id, business_date) as total from o),
    e as (select *, round(weight * total / sum(weight) over (partition by store_id, business_date), 9) as e from w), f as (select *, floor(e) as f from e)
    select order_id, cast(f + case when row_number() over (partition by store_id, business_date order by round(e - f, 9) desc, order_id) <= round(sum(e) over (partition by store_id, business_date)) - sum(f) over (partition by store_id, business_date) then 1 else 0 end as bigint) as units from f""")
def exact_total_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes drawn for every order and nudged so that each store and day sells exactly three units an order."""
    o = Star(spark, d).orders().select("order_id", "store_id", "business_date").withColumn("weight", 1 + F.floor(g.uniform("size", F.col("order_id")) * 6))
    day = ["store_id", "business_date"]
    total = F.lit(3) * F.count("*").over(W.partitionBy(*day))
    return g.largest_remainder(o.withColumn("total", total), "weight", F.col("total"), "order_id", day).select("order_id", "units")


@query(f"""with {STAR_SQL}, {CATEGORY_SQL}, u as (select *, {_U.format("'spikes|' || store_id || '|' || category || '|' || business_date")} as u from daily_category_sales)
    select store_id, category, business_date, units, cast(case when u < 0.001 then 10 + units * 4 else units end as bigint) as planted, u < 0.001 as is_spike from u where u < 0.002""")
def planted_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Store-category-days of which one in a thousand is multiplied (those drawn, and as many beside them)."""
    u = g.uniform("spikes", F.col("store_id"), F.col("category"), F.col("business_date"))
    x = daily_category_sales(spark, d).select("store_id", "category", "business_date", "units", u.alias("u")).where("u < 0.002")
    return x.select("store_id", "category", "business_date", "units", F.when(F.col("u") < 0.001, 10 + F.col("units") * 4).otherwise(F.col("units")).alias("planted"), (F.col("u") < 0.001).alias("is_spike"))


@query(f"""with h as (select distinct l_orderkey as o, p_brand as b from lineitem join part on p_partkey = l_partkey), a as (select o, case b when 'Brand#1' then 'Brand#2' else 'Brand#4' end as b from h where b in ('Brand#1', 'Brand#3') and {_U.format("'affinity|' || o || '|' || b")} < 0.6)
    select b as brand, cast(count(*) as bigint) as orders, cast(count(*) filter (planted) as bigint) as planted from (select o, b, bool_and(planted) as planted from (select o, b, false as planted from h union all select o, b, true from a) group by 1, 2) group by 1""")
def planted_affinity(spark: SparkSession, d: str) -> DataFrame:
    """Orders with one brand of a planted pair get the other with a chance of 0.6; brands per order, and how many were added."""
    s = Star(spark, d)
    held = s.table("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("product_id")).join(s.products(), "product_id").select("o", F.col("brand").alias("b")).distinct()
    other = F.when(F.col("b") == "Brand#1", "Brand#2").when(F.col("b") == "Brand#3", "Brand#4")
    drawn = held.where(other.isNotNull() & (g.uniform("affinity", F.col("o"), F.col("b")) < 0.6)).select("o", other.alias("b"), F.lit(True).alias("planted"))
    both = held.withColumn("planted", F.lit(False)).unionByName(drawn).groupBy("o", "b").agg(F.bool_and("planted").alias("planted"))
    return both.groupBy(F.col("b").alias("brand")).agg(F.count("*").alias("orders"), F.count_if("planted").alias("planted"))


@query(f"""with recursive {STAR_SQL}, {CATEGORY_SQL}, n as (select store_id, category, units, row_number() over (partition by store_id, category order by business_date) as i from daily_category_sales),
    run(store_id, category, i, stock, nxt, aft, sold, lost, orders, empty) as (select store_id, category, cast(0 as bigint), cast(60 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint) from n where i = 1
      union all select r.store_id, r.category, r.i + 1, stock + nxt - least(stock + nxt, units), aft, case when stock + nxt - least(stock + nxt, units) + aft <= 25 then 80 - (stock + nxt - least(stock + nxt, units)) - aft else 0 end, sold + least(stock + nxt, units), lost + units - least(stock + nxt, units),
        orders + case when stock + nxt - least(stock + nxt, units) + aft <= 25 then 1 else 0 end, empty + case when stock + nxt - least(stock + nxt, units) = 0 then 1 else 0 end from run r join n on n.store_id = r.store_id and n.category = r.category and n.i = r.i + 1)
    select store_id, category, cast(i as int) as days, sold, lost, orders, empty as empty_days, stock from run qualify row_number() over (partition by store_id, category order by i desc) = 1""")
def inventory_simulation(spark: SparkSession, d: str) -> DataFrame:
    """A reorder policy run over the demand of every store and category."""
    return g.simulated_stock(daily_category_sales(spark, d), ["store_id", "category"], "business_date", "units", 60, 25, 80)


@query(f"""with {STAR_SQL}, x as (select order_id, l.category, promotion_id, round(sum(cast(revenue as double)) * (length(l.category) % 5 + 5) / 100, 2) as discount from l join promo on promo.category = l.category and l.business_date between start_date and end_date group by 1, 2, 3, length(l.category))
    select order_id, promotion_id, discount from (select *, row_number() over (partition by order_id order by discount desc, promotion_id) as r from x) where r = 1""")
def best_promotion_by_discount(spark: SparkSession, d: str) -> DataFrame:
    """For every order the promotion in force on its day that saves most on its lines: an interval join by exploded days, then the top one."""
    s = Star(spark, d)
    days = s.promotions().select("promotion_id", "category", F.explode(F.sequence("start_date", "end_date", F.expr("interval 1 day"))).alias("business_date"))
    each = s.order_lines().join(days, ["category", "business_date"]).groupBy("order_id", "category", "promotion_id").agg(F.sum("revenue").cast("double").alias("r"))
    saved = each.withColumn("discount", F.round(F.col("r") * (F.length("category") % 5 + 5) / 100, 2))
    best = F.min_by(F.struct("promotion_id", "discount"), F.struct(-F.col("discount"), F.col("promotion_id")))
    return saved.groupBy("order_id").agg(best.alias("b")).select("order_id", "b.*")


_DRAWN = lambda name: _U.format(f"'{name}|' || o_orderkey")


@query(f"""with d as (select o_orderkey, case when {_DRAWN('failed')} < 0.03 then 'failed' else 'delivered' end as status, 8 + cast(floor({_DRAWN('minutes')} * 20) as int) as minutes, 1 + cast(floor({_DRAWN('attempts')} * 1.2) as int) as attempts, {_DRAWN('refund')} < 0.05 as refunded, 1 + cast(floor({_DRAWN('rating')} * 5) as int) as rating, {_DRAWN('review')} < 0.3 as reviewed from orders)
    select status, cast(count(*) as bigint) as orders, cast(sum(minutes) as bigint) as minutes, cast(sum(attempts) as bigint) as attempts, cast(count(*) filter (refunded and status = 'delivered') as bigint) as refunds, cast(sum(rating) filter (reviewed) as bigint) as rating_points from d group by 1""")
def downstream_events(spark: SparkSession, d: str) -> DataFrame:
    """Delivery, payment attempts, refund and review drawn for every order from streams of their own; totals by delivery status."""
    u = lambda name: g.uniform(name, F.col("o_orderkey"))
    x = table(spark, d, "orders").select(
        F.when(u("failed") < 0.03, "failed").otherwise("delivered").alias("status"), (8 + F.floor(u("minutes") * 20)).alias("minutes"), (1 + F.floor(u("attempts") * 1.2)).alias("attempts"),
        (u("refund") < 0.05).alias("refunded"), (1 + F.floor(u("rating") * 5)).alias("rating"), (u("review") < 0.3).alias("reviewed"),
    )
    return x.groupBy("status").agg(F.count("*").alias("orders"), F.sum("minutes").alias("minutes"), F.sum("attempts").alias("attempts"), F.count_if(F.col("refunded") & (F.col("status") == "delivered")).alias("refunds"), F.sum(F.when(F.col("reviewed"), F.col("rating"))).alias("rating_points"))


@query(f"""with s as (select c_custkey, unnest(range(1, 2 + cast(floor({_U.format("'visits|' || c_custkey")} * 5) as int))) as i from customer), e as (select c_custkey, i, {_U.format("'step|' || c_custkey || '|' || i")} as u from s)
    select case when u < 0.5 then 'view' when u < 0.8 then 'search' when u < 0.95 then 'cart' else 'checkout' end as step, case when u < 0.01 then 'ERROR' when u < 0.05 then 'WARN' else 'INFO' end as log_level, cast(count(*) as bigint) as n, cast(count(distinct c_custkey) as bigint) as customers from e group by 1, 2""")
def synthetic_sessions(spark: SparkSession, d: str) -> DataFrame:
    """App sessions: one to five steps for every customer with a step and a log level drawn for each."""
    c = table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), (1 + F.floor(g.uniform("visits", F.col("c_custkey")) * 5)).cast("int"))).alias("i"))
    u = g.uniform("step", F.col("c_custkey"), F.col("i"))
    x = c.select("c_custkey", F.when(u < 0.5, "view").when(u < 0.8, "search").when(u < 0.95, "cart").otherwise("checkout").alias("step"), F.when(u < 0.01, "ERROR").when(u < 0.05, "WARN").otherwise("INFO").alias("log_level"))
    return x.groupBy("step", "log_level").agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("customers"))


WEATHER_SQL = f"""select city_id, business_date, case when u < 0.2 then round(u * 200, 1) else 0 end as rainfall_mm, round(22 + 8 * sin((month(business_date) - 4) * 0.5235987755982988) + 4 * (v - 0.5), 1) as temperature_c
    from (select r_regionkey as city_id, business_date, {_U.format("'rain|' || r_regionkey || '|' || business_date")} as u, {_U.format("'heat|' || r_regionkey || '|' || business_date")} as v from region, cal)"""


@query(f"with {STAR_SQL} {WEATHER_SQL}")
def synthetic_weather(spark: SparkSession, d: str) -> DataFrame:
    """Rain and temperature of every city and day: a yearly wave and draws by city and day."""
    s = Star(spark, d)
    x = s.spine(s.table("region").select(F.col("r_regionkey").alias("city_id")))
    u, v = (g.uniform(n, F.col("city_id"), F.col("business_date")) for n in ("rain", "heat"))
    return x.select("city_id", "business_date", F.when(u < 0.2, F.round(u * 200, 1)).otherwise(0.0).alias("rainfall_mm"), F.round(22 + 8 * F.sin((F.month("business_date") - 4) * 0.5235987755982988) + 4 * (v - 0.5), 1).alias("temperature_c"))


@query("select * from (values ('case', 27), ('spaces', 13)) v(fault, n)")
def issue_budget(spark: SparkSession, d: str) -> DataFrame:
    """How many of 1,000 rows get each fault that applies: the share of one that does not goes to the others."""
    return spark.createDataFrame(list(g.budget(1000, {"case": 0.02, "spaces": 0.01, "price": 0.01}, ["case", "spaces"]).items()), "fault string, n int")


_SPOILED_SQL = {
    "null": "null", "empty": "''", "blank": "'   '", "leading_space": "'  ' || v", "trailing_space": "v || ' '", "inner_spaces": "replace(v, ' ', '  ')", "tab": "v || chr(9)", "line_end": "v || chr(10)", "upper": "upper(v)", "lower": "lower(v)", "truncated": "v[1:3]", "first_lost": "v[2:]",
    "last_doubled": "v || right(v, 1)", "reversed": "reverse(v)", "letter_for_digit": "translate(v, '01', 'OI')", "text_in_number": "v || 'abc'", "negative": "'-' || v", "zero": "'0'", "huge": "'99999999999999999999'", "fraction": "v || '.5'", "decimal_comma": "replace(v, '.', ',')", "thousands_mark": "v || ',000'",
    "currency": "'Rs ' || v", "exponent": "v || 'e3'", "quoted": "'\"' || v || '\"'", "open_quote": "'\"' || v", "separator": "v || ','", "markup": "'<b>' || v || '</b>'", "unknown_word": "'n/a'", "bad_date": "'2025-02-30'", "other_date_order": "'31/12/2025 10:00:00'", "far_future": "'2199-01-01T00:00:00Z'",
}


@query(f"""with x as (select o_orderkey as order_id, cast(o_orderkey as varchar) || ' No.1' as v, cast(floor({_U.format("'mutations|' || o_orderkey")} * {len(_SPOILED_SQL)}) as int) as w from orders)
    select order_id, case w {" ".join(f"when {i} then '{n}'" for i, n in enumerate(_SPOILED_SQL))} end as mutation, case w {" ".join(f"when {i} then {e}" for i, e in enumerate(_SPOILED_SQL.values()))} end as v from x""")
def row_mutations(spark: SparkSession, d: str) -> DataFrame:
    """A text of every order spoiled in one of 32 ways, drawn by its key."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(" No.1")).alias("v"))
    return g.spoiled(o, "order_id", "v")


_SLICED_SQL = f"""s as (select o_orderkey as order_id, cast(o_orderdate as date) as d, {_U.format("'slices|' || o_orderkey")} < 0.02 as late, {_U.format("'faults|' || o_orderkey")} as f from orders),
    t as (select order_id, case when d < date '2001-07-01' then 'historical' else 'batch_' || strftime(case when late then d + 1 else d end, '%Y-%m-%d') end as slice, late and d >= date '2001-07-01' as is_late, case when f < 0.02 then 'missing' when f < 0.03 then 'negative' end as fault from s)"""


def _landing(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("event"), F.col("o_totalprice").alias("total"))
    faults = {"missing": (0.02, {"total": F.lit(None)}), "negative": (0.01, {"total": -F.col("total")})}
    return g.with_faults(g.sliced(o, "order_id", "event", F.lit("2001-07-01").cast("date")), "order_id", faults)


@query(f"with {_SLICED_SQL} select slice, cast(count(*) as bigint) as n_rows, cast(count(*) filter (is_late) as bigint) as late from t group by 1")
def landing_slices(spark: SparkSession, d: str) -> DataFrame:
    """Orders delivered as history and daily batches, one in fifty a day late, written by slice and read back from the folders."""
    path = f"{shared_dir(spark)}/slices-{uuid.uuid4().hex}"
    _landing(spark, d).repartition("slice").sortWithinPartitions("slice", "place", "order_id").write.partitionBy("slice").parquet(path)
    return spark.read.parquet(path).groupBy("slice").agg(F.count("*").alias("n_rows"), F.count_if("is_late").alias("late"))


@query(f"""with {_SLICED_SQL} select slice, cast(count(*) as bigint) as n_rows, cast(count(distinct order_id) as bigint) as keys, cast(sum(order_id * 2654435761 % 1000003) as bigint) as checksum, cast(count(*) filter (fault = 'missing') as bigint) as missing, cast(count(*) filter (fault = 'negative') as bigint) as negative from t group by 1""")
def landing_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What each slice was delivered with, and the truth about its planted faults."""
    m = g.manifest(_landing(spark, d), "slice", "order_id", "fault")
    kind = lambda n: F.coalesce(F.try_element_at("faults", F.lit(n)), F.lit(0)).cast("bigint").alias(n)
    return m.select("slice", F.col("rows").alias("n_rows"), "keys", "checksum", kind("missing"), kind("negative"))
