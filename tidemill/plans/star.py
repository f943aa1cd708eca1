"""The star the marts read, mapped from the order tables.

store = nation of the customer, city = its region, category = part type, product = part; an order is completed (F),
cancelled (P) or open (O); a returned line is refunded on its ship date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.functions.expressions import money
from tidemill.sources.tables import table


class Star:
    """Shared relations over one folder of tables; each is a lazy plan, so unused columns never leave the scan."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    def stores(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").alias("store_id"), F.col("n_name").alias("store_name"), F.col("n_regionkey").alias("city_id"))

    def products(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"))

    def orders(self) -> DataFrame:
        """One row per order with its store, business date and status flags."""
        o = self.table("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("business_date"), F.col("o_orderstatus").alias("status"), money(F.col("o_totalprice")).alias("total_amount"))
        c = self.table("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("store_id"))
        return o.join(c, "customer_id").withColumns({"is_completed": F.col("status") == "F", "is_cancelled": F.col("status") == "P"})

    def order_lines(self) -> DataFrame:
        """One row per line: quantity and revenue (price less discount, an exact decimal), with its product and order."""
        i = self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("gross"),
            (F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)").alias("revenue"),
            F.col("l_returnflag").alias("return_flag"),
            F.to_date("l_shipdate").alias("ship_date"),
        )
        return i.join(self.products().select("product_id", "category", "brand"), "product_id").join(self.orders(), "order_id")

    def completed_lines(self) -> DataFrame:
        return self.order_lines().where("is_completed")

    def calendar(self) -> DataFrame:
        """Every business date from the first order to the last: one row, exploded; day_of_week 1 = Monday."""
        days = self.table("orders").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
        return days.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("business_date")).select(
            "business_date", (F.weekday("business_date") + 1).alias("day_of_week"), (F.weekday("business_date") >= 5).alias("is_weekend")
        )

    def spine(self, *dims: DataFrame) -> DataFrame:
        """The grid of the calendar and small dimension lists; their sizes are those of the result's own key."""
        grid = self.calendar().select("business_date")
        for d in dims:
            grid = grid.join(F.broadcast(d))
        return grid

    def promotions(self) -> DataFrame:
        """One 30-day promotion per category, placed by a rule both engines can compute."""
        kinds = self.products().select("category").distinct()
        start = F.date_add(F.lit("1996-01-01").cast("date"), (F.length("category") * 37).cast("int"))
        return kinds.select(F.concat(F.lit("promo-"), "category").alias("promotion_id"), "category", start.alias("start_date"), F.date_add(start, 29).alias("end_date"))


#: The same relations for the SQL side.
STAR_SQL = """
    o as (select o_orderkey as order_id, o_custkey as customer_id, cast(o_orderdate as date) as business_date, o_orderstatus as status, cast(o_totalprice as decimal(18,2)) as total_amount, c_nationkey as store_id,
            o_orderstatus = 'F' as is_completed, o_orderstatus = 'P' as is_cancelled from orders join customer on c_custkey = o_custkey),
    l as (select l_orderkey as order_id, l_partkey as product_id, cast(l_quantity as bigint) as quantity, cast(l_extendedprice as decimal(12,2)) as gross, cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(18,4)) as revenue, l_returnflag as return_flag,
            cast(l_shipdate as date) as ship_date, p_type as category, p_brand as brand, o.* exclude (order_id) from lineitem join part on p_partkey = l_partkey join o on o.order_id = l_orderkey),
    cal as (select cast(unnest(generate_series(min(cast(o_orderdate as date)), max(cast(o_orderdate as date)), interval 1 day)) as date) as business_date from orders),
    promo as (select 'promo-' || category as promotion_id, category, date '1996-01-01' + cast(length(category) * 37 as int) as start_date, date '1996-01-01' + cast(length(category) * 37 + 29 as int) as end_date
            from (select distinct p_type as category from part))"""

trailing = lambda *keys: W.partitionBy(*keys).orderBy("business_date")
