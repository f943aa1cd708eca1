"""Marts over the validated datasets of the shop, and features from outside the sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.functions.expressions import ratio, week_start
from tidemill.plans import synthetic
from tidemill.plans.datasets import Shop, chain_sql
from tidemill.plans.marts import CATEGORY_SQL
from tidemill.plans.registry import Registry
from tidemill.plans.star import STAR_SQL, Star
from tidemill.plans.stats import INVENTORY_SQL, inventory_daily

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: The days that are holidays whatever the year, as MM-dd.
HOLIDAYS = ("01-01", "01-26", "05-01", "08-15", "10-02", "12-25")


@query(f"""{chain_sql("orders", "cancellations")}, placed as (select store_id, cast(date_trunc('week', business_date) as date) as week, count(*) as placed from orders_valid group by 1, 2),
    c as (select o.store_id, cast(date_trunc('week', o.business_date) as date) as week, c.stage, c.reason, count(*) as n from cancellations_valid c join orders_valid o on o.order_id = c.order_id group by 1, 2, 3, 4)
    select c.store_id, c.week, stage, reason, cast(n as bigint) as cancellations, round(n / placed, 4) as share_of_orders from c join placed p on p.store_id = c.store_id and p.week = c.week""")
def cancellations_by_stage(spark: SparkSession, d: str) -> DataFrame:
    """Cancellations per store, week of the order, stage and reason, as a share of that week's orders."""
    shop = Shop(spark, d)
    orders = shop.get("orders").valid.select("order_id", "store_id", week_start(F.col("business_date")).alias("week"))
    placed = orders.groupBy("store_id", "week").agg(F.count("*").alias("placed"))
    n = shop.get("cancellations").valid.select("order_id", "stage", "reason").join(orders, "order_id").groupBy("store_id", "week", "stage", "reason").agg(F.count("*").alias("cancellations"))
    return n.join(placed, ["store_id", "week"]).select("store_id", "week", "stage", "reason", "cancellations", ratio(F.col("cancellations"), F.col("placed")).alias("share_of_orders"))


@query(f"""{chain_sql("order_promotions", "order_items", "products")}, used as (select promotion_id, count(distinct order_id) as orders, sum(discount_amount) as cost from order_promotions_valid group by 1),
    days as (select category_id, o.business_date as d, sum(quantity) as units from order_items_valid i join products_valid p on p.product_id = i.product_id join orders_valid o on o.order_id = i.order_id group by 1, 2),
    ends as (select min(business_date) as a, max(business_date) as b from orders_valid), cal as (select cast(unnest(generate_series(a, b, interval 1 day)) as date) as d from ends),
    x as (select p.promotion_id, cal.d between p.start_date and p.end_date as active, coalesce(units, 0) as units from promotions_valid p cross join cal left join days on days.category_id = p.category_id and days.d = cal.d),
    a as (select promotion_id, round(avg(units) filter (active), 2) as promo_units, round(avg(units) filter (not active), 2) as other_units from x group by 1)
    select p.promotion_id, p.category_id, p.end_date - p.start_date + 1 as days_active, cast(coalesce(orders, 0) as bigint) as orders, cast(coalesce(cost, 0) as decimal(18,2)) as cost, promo_units, other_units, case when other_units > 0 then round(round((promo_units - other_units) / other_units, 4) * 100, 1) end as uplift_pct
    from promotions_valid p left join used on used.promotion_id = p.promotion_id left join a on a.promotion_id = p.promotion_id""")
def promotion_usage(spark: SparkSession, d: str) -> DataFrame:
    """Orders and cost of every promotion, and its category's daily units on its days against all others."""
    shop = Shop(spark, d)
    promotions, orders, items, products = (shop.get(n).valid for n in ("promotions", "orders", "order_items", "products"))
    used = shop.get("order_promotions").valid.groupBy("promotion_id").agg(F.count_distinct("order_id").alias("orders"), F.sum("discount_amount").alias("cost"))
    days = items.join(products.select("product_id", "category_id"), "product_id").join(orders.select("order_id", "business_date"), "order_id").groupBy("category_id", "business_date").agg(F.sum("quantity").alias("units"))
    ends = orders.agg(F.min("business_date").alias("a"), F.max("business_date").alias("b"))
    calendar = F.broadcast(ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("business_date")))  # one row per day
    active = F.col("business_date").between(F.col("start_date"), F.col("end_date"))
    x = promotions.select("promotion_id", "category_id", "start_date", "end_date").crossJoin(calendar).join(days, ["category_id", "business_date"], "left").fillna(0, ["units"])
    means = x.groupBy("promotion_id").agg(F.round(F.avg(F.when(active, F.col("units"))), 2).alias("promo_units"), F.round(F.avg(F.when(~active, F.col("units"))), 2).alias("other_units"))
    up = F.round(ratio(F.col("promo_units") - F.col("other_units"), F.col("other_units")) * 100, 1)
    full = promotions.join(used, "promotion_id", "left").join(means, "promotion_id", "left")
    return full.select("promotion_id", "category_id", (F.datediff("end_date", "start_date") + 1).cast("bigint").alias("days_active"), F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("cost", F.lit(0)).cast("decimal(18,2)").alias("cost"), "promo_units", "other_units", up.alias("uplift_pct"))


_HOLIDAYS_SQL = "(" + ", ".join(f"'{h}'" for h in HOLIDAYS) + ")"


@query(f"""with {STAR_SQL}, {CATEGORY_SQL}, {INVENTORY_SQL}, sky as ({synthetic.WEATHER_SQL}),
    empty as (select store_id, business_date, round(avg(case when is_stockout then 1.0 else 0.0 end), 4) as share from inventory_daily group by 1, 2), lagged as (select store_id, business_date, lag(share) over (partition by store_id order by business_date) as stockout_share_lag from empty)
    select lagged.store_id, lagged.business_date, rainfall_mm, temperature_c, strftime(lagged.business_date, '%m-%d') in {_HOLIDAYS_SQL} as is_holiday, isodow(lagged.business_date) >= 6 as is_weekend, stockout_share_lag
    from lagged join nation on n_nationkey = lagged.store_id join sky on sky.city_id = n_regionkey and sky.business_date = lagged.business_date""")
def demand_features_exogenous(spark: SparkSession, d: str) -> DataFrame:
    """Weather of the store's city, holidays, weekends and the day before's share of categories out of stock, per store and day."""
    share = inventory_daily(spark, d).groupBy("store_id", "business_date").agg(F.round(F.avg(F.col("is_stockout").cast("double")), 4).alias("share"))
    lagged = share.select("store_id", "business_date", F.lag("share").over(W.partitionBy("store_id").orderBy("business_date")).alias("stockout_share_lag"))
    stores = Star(spark, d).stores().select("store_id", "city_id")
    x = lagged.join(stores, "store_id").join(synthetic.synthetic_weather(spark, d), ["city_id", "business_date"])
    return x.select("store_id", "business_date", "rainfall_mm", "temperature_c", F.date_format("business_date", "MM-dd").isin(list(HOLIDAYS)).alias("is_holiday"), (F.weekday("business_date") >= 5).alias("is_weekend"), "stockout_share_lag")
