"""Stock per store and product rebuilt from events: sales, stock events and counts in one ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.functions.expressions import ratio
from tidemill.operators.rolling import dense_days
from tidemill.plans.datasets import Shop, chain_sql
from tidemill.plans.registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql

PAIR = ["store_id", "product_id"]
_LOCAL = "interval '330' minute"


def ledger(moves: DataFrame, counts: DataFrame) -> DataFrame:
    """Every event with the stock after it: (store_id, product_id, ts, kind, delta, counted, reorder_level, stock, first_base, gap, place).

    moves: (*PAIR, ts, kind, delta); counts: (*PAIR, ts, counted, reorder_level). At one instant movements come before
    counts, and among themselves by size and kind, so that the order is the same in every run. Stock is the last count plus
    the movements since; before the first count it is reckoned backwards from that. gap: a count less what was reckoned
    from the count before. Pairs that were never counted are left out. One shuffle and one sort serve all windows.
    """
    moved = moves.join(counts.select(*PAIR).distinct(), PAIR, "left_semi").select(*PAIR, "ts", F.lit(0).alias("p"), "kind", "delta", F.lit(None).cast("int").alias("counted"), F.lit(None).cast("int").alias("reorder_level"))
    counted = counts.select(*PAIR, "ts", F.lit(1).alias("p"), F.lit("count").alias("kind"), F.lit(0).alias("delta"), "counted", "reorder_level")
    w = W.partitionBy(*PAIR).orderBy("ts", "p", "delta", "kind")
    so_far, before, whole = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = moved.unionByName(counted).withColumn("cum", F.sum("delta").over(so_far)).withColumn("base", F.col("counted") - F.col("cum"))
    x = x.withColumns({"first_base": F.first("base", ignorenulls=True).over(whole), "last_base": F.last("base", ignorenulls=True).over(so_far), "gap": F.col("base") - F.last("base", ignorenulls=True).over(before), "place": F.row_number().over(w)})
    return x.withColumn("stock", F.col("cum") + F.coalesce("last_base", "first_base")).drop("cum", "base", "last_base", "p")


def stock_days(moves: DataFrame, counts: DataFrame, day) -> DataFrame:
    """The ledger by pair and calendar day, days without events included: opening and closing stock, movements by kind, counts, cover.

    The calendar runs from the first to the last day of all events. Opening and closing are at least 0; a day is out of
    stock if its lowest stock is 0 or less, negative if under 0. Cover: closing stock over the mean units sold of 14 days.
    """
    total = lambda kind, sign: F.sum(F.when(F.col("kind") == kind, sign * F.col("delta")))
    daily = ledger(moves, counts).groupBy(*PAIR, day(F.col("ts")).alias("business_date")).agg(
        F.max_by("stock", "place").alias("close"),
        F.min(F.when(F.col("kind") != "count", F.col("stock"))).alias("lowest"),
        F.max("first_base").alias("base"),
        total("sale", -1).alias("units_sold"),
        total("restock", 1).alias("restocked"),
        total("damage", -1).alias("damaged"),
        total("adjustment", 1).alias("adjusted"),
        F.max_by("counted", F.when(F.col("counted").isNotNull(), F.col("place"))).alias("counted"),
        F.max_by("gap", F.when(F.col("counted").isNotNull(), F.col("place"))).alias("gap"),
        F.max_by("reorder_level", F.when(F.col("reorder_level").isNotNull(), F.col("place"))).alias("reorder"),
    )
    ends = daily.agg(F.min("business_date").alias("__from"), F.max("business_date").alias("__to"))
    values = ["close", "lowest", "base", "units_sold", "restocked", "damaged", "adjusted", "counted", "gap", "reorder"]
    grid = dense_days(daily.join(F.broadcast(ends)), PAIR, "business_date", values, F.col("__from"), F.col("__to"))  # one row
    w = W.partitionBy(*PAIR).orderBy("business_date")
    so_far, before, whole = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = lambda c, frame: F.last(c, ignorenulls=True).over(frame)
    start = F.first("base", ignorenulls=True).over(whole)
    x = grid.fillna(0, ["units_sold", "restocked", "damaged", "adjusted"]).withColumns(
        {"o": F.coalesce(filled("close", before), start), "c": F.coalesce(filled("close", so_far), start), "r": F.coalesce(filled("reorder", so_far), F.first("reorder", ignorenulls=True).over(whole)), "sold_14": F.round(F.avg("units_sold").over(w.rowsBetween(-13, 0)), 3)}
    )
    low = F.least("o", "c", F.coalesce("lowest", "c"))
    closing = F.greatest("c", F.lit(0))
    return x.select(
        *PAIR, "business_date", F.greatest("o", F.lit(0)).cast("int").alias("opening_stock"), closing.cast("int").alias("closing_stock"), *[F.col(c).cast("bigint").alias(c) for c in ("units_sold", "restocked", "damaged", "adjusted")],
        F.col("counted").alias("snapshot_stock"), F.col("gap").cast("int").alias("reconciliation_gap"), F.col("r").cast("int").alias("reorder_level"), (low < 0).alias("calculated_negative"), (low <= 0).alias("is_stockout"), (closing <= F.col("r")).alias("below_reorder_level"), "sold_14", ratio(closing, F.col("sold_14"), 2).alias("days_of_inventory"),
    )


_ORDER = "partition by store_id, product_id order by ts, p, delta, kind"
_DAYS_SQL = f"""{chain_sql("order_items", "orders", "cancellations", "inventory_snapshots", "inventory_events")},
    sn as (select store_id, product_id, snapshot_ts as ts, stock_quantity as v, reorder_level as r from inventory_snapshots_valid), pairs as (select distinct store_id, product_id from sn),
    mv as (select o.store_id, i.product_id, o.order_ts as ts, 'sale' as kind, -i.quantity as delta from order_items_valid i join orders_valid o on o.order_id = i.order_id where o.order_id not in (select order_id from cancellations_valid where stage = 'pre_dispatch')
      union all select store_id, product_id, event_ts, event_type, quantity from inventory_events_valid),
    m as (select * from mv join pairs using (store_id, product_id)),
    ends as (select min(d) as a, max(d) as b from (select cast(ts + {_LOCAL} as date) as d from m union all select cast(ts + {_LOCAL} as date) from sn)), cal as (select cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from ends),
    stream as (select store_id, product_id, ts, 2 as p, kind, delta, null as v, null as r, null as day from m union all select store_id, product_id, ts, 3, 'snapshot', 0, v, r, null from sn
      union all select store_id, product_id, cast(day as timestamp) - {_LOCAL}, 1, 'day_start', 0, null, null, day from pairs, cal union all select store_id, product_id, cast(day as timestamp) + interval 1 day - {_LOCAL}, 0, 'day_end', 0, null, null, day from pairs, cal),
    run as (select *, sum(delta) over ({_ORDER} rows unbounded preceding) as cum from stream),
    based as (select *, last_value(v - cum ignore nulls) over ({_ORDER} rows unbounded preceding) as b, last_value(v - cum ignore nulls) over ({_ORDER} rows between unbounded preceding and 1 preceding) as b0, first_value(v - cum ignore nulls) over ({_ORDER} rows between unbounded preceding and unbounded following) as f,
      last_value(r ignore nulls) over ({_ORDER} rows unbounded preceding) as rl, first_value(r ignore nulls) over ({_ORDER} rows between unbounded preceding and unbounded following) as rf from run),
    st as (select *, cum + coalesce(b, f) as stock, coalesce(day, cast(ts + {_LOCAL} as date)) as d from based),
    per as (select store_id, product_id, d, sum(case when kind = 'sale' then -delta end) as sold, sum(case when kind = 'restock' then delta end) as restocked, sum(case when kind = 'damage' then -delta end) as damaged, sum(case when kind = 'adjustment' then delta end) as adjusted, min(stock) as lowest from st where p = 2 group by 1, 2, 3),
    rec as (select store_id, product_id, d, v as counted, v - cum - b0 as gap from (select *, row_number() over (partition by store_id, product_id, d order by ts desc, cum) as n from st where p = 3) where n = 1),
    j as (select o.store_id, o.product_id, o.d as business_date, o.stock as o, c.stock as c, coalesce(c.rl, c.rf) as rl, coalesce(sold, 0) as sold, coalesce(restocked, 0) as restocked, coalesce(damaged, 0) as damaged, coalesce(adjusted, 0) as adjusted, lowest, counted, gap
      from (select * from st where kind = 'day_start') o join (select * from st where kind = 'day_end') c on c.store_id = o.store_id and c.product_id = o.product_id and c.d = o.d left join per on per.store_id = o.store_id and per.product_id = o.product_id and per.d = o.d left join rec on rec.store_id = o.store_id and rec.product_id = o.product_id and rec.d = o.d),
    k as (select *, round(avg(sold) over (partition by store_id, product_id order by business_date rows between 13 preceding and current row), 3) as sold_14, least(o, c, coalesce(lowest, c)) as low from j)
    select store_id, product_id, business_date, cast(greatest(o, 0) as int) as opening_stock, cast(greatest(c, 0) as int) as closing_stock, cast(sold as bigint) as units_sold, cast(restocked as bigint) as restocked, cast(damaged as bigint) as damaged, cast(adjusted as bigint) as adjusted, cast(counted as int) as snapshot_stock, cast(gap as int) as reconciliation_gap,
      cast(rl as int) as reorder_level, low < 0 as calculated_negative, low <= 0 as is_stockout, greatest(c, 0) <= rl as below_reorder_level, sold_14, case when sold_14 > 0 then round(greatest(c, 0) / sold_14, 2) end as days_of_inventory from k"""


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    shop = Shop(spark, d)
    orders, items, cancelled, counts, events = (shop.get(n).valid for n in ("orders", "order_items", "cancellations", "inventory_snapshots", "inventory_events"))
    kept = orders.join(cancelled.where("stage = 'pre_dispatch'").select("order_id"), "order_id", "left_anti").select("order_id", "store_id", F.col("order_ts").alias("ts"))
    sales = items.select("order_id", "product_id", (-F.col("quantity")).alias("delta")).join(kept, "order_id").select(*PAIR, "ts", F.lit("sale").alias("kind"), "delta")
    moves = sales.unionByName(events.select(*PAIR, F.col("event_ts").alias("ts"), F.col("event_type").alias("kind"), F.col("quantity").alias("delta")))
    return moves, counts.select(*PAIR, F.col("snapshot_ts").alias("ts"), F.col("stock_quantity").alias("counted"), "reorder_level")


@query(_DAYS_SQL)
def stock_ledger_daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily stock of every counted store and product from sales, stock events and counts, with reconciliation gaps and days of cover."""
    return stock_days(*_parts(spark, d), lambda ts: F.to_date(ts + F.expr(_LOCAL)))
