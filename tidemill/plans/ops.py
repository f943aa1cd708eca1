"""Run metadata: load summaries, lineage and what is reachable in it, the catalogue of tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.plans.registry import Registry
from tidemill.scale import written
from tidemill.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: Which tables are made from which.
EDGES = (
    ("landing/orders", "slv_orders"), ("landing/order_items", "slv_order_items"), ("landing/payments", "brz_payments"), ("landing/stores", "stores"), ("landing/products", "products"),
    ("slv_orders", "slv_order_items"), ("stores", "slv_orders"), ("products", "slv_order_items"), ("slv_orders", "gld_daily_sales"), ("slv_order_items", "gld_daily_sales"), ("brz_payments", "gld_daily_sales"),
    ("slv_order_items", "gld_demand_predictions"), ("gld_daily_sales", "gld_demand_predictions"), ("slv_orders", "gld_quality_summary"), ("slv_order_items", "gld_quality_summary"), ("brz_payments", "gld_quality_summary"),
)
EDGES_SQL = "(values " + ", ".join(f"('{a}', '{b}')" for a, b in EDGES) + ") e(source, target)"


def layer(name):
    """The layer of a table by its prefix."""
    return F.when(name.startswith("landing/"), "landing").when(name.startswith("brz_"), "bronze").when(name.startswith("slv_"), "silver").when(name.startswith("gld_"), "gold").when(name.startswith("ops_"), "ops").otherwise("dimension")


def merged_edges(*logs: DataFrame) -> DataFrame:
    """Edges of several logs (source, target, logged_at), the latest of each pair."""
    return reduce(DataFrame.unionByName, logs).groupBy("source", "target").agg(F.max("logged_at").alias("logged_at"))


def reachable(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(ancestor, descendant, distance) of every pair connected in a directed graph, whatever the distance; cycles are allowed.

    Breadth first: each round extends only the pairs that the round before found new (anti-join with all seen) and writes
    them, until nothing is new. A table on a cycle is its own descendant. Null ends make no edge.
    """
    e = written(edges.select(F.col(source).alias("ancestor"), F.col(target).alias("descendant")).where("ancestor is not null and descendant is not null").distinct(), "edges")
    fresh = written(e.select("*", F.lit(1).alias("distance")), "reached")
    seen, distance = fresh, 1
    while not fresh.isEmpty():
        distance += 1
        onward = fresh.select("ancestor", F.col("descendant").alias("via")).join(e.select(F.col("ancestor").alias("via"), "descendant"), "via").select("ancestor", "descendant").distinct()
        fresh = written(onward.join(seen, ["ancestor", "descendant"], "left_anti").select("ancestor", "descendant", F.lit(distance).alias("distance")), "reached")
        seen = seen.unionByName(fresh)
    return seen


def scrubbed_text(text: str) -> str:
    """The same of one error text on the driver."""
    return re.sub(r"/(?:home|root|tmp|Users)/[^\s'\"]+", "<path>", re.sub(r"(?i)[a-z]:\\[^\s'\"]+", "<path>", text))[:300]


def scrubbed(text):
    """An error text without local paths and user names, at most 300 characters."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?i)[a-z]:\\[^\s'\"]+", "<path>"), r"/(?:home|root|tmp|Users)/[^\s'\"]+", "<path>")
    return F.substring(plain, 1, 300)


@query(f"""with recursive e as (select * from {EDGES_SQL}), walk(ancestor, descendant, distance) as (select source, target, 1 from e union all select w.ancestor, e.target, w.distance + 1 from walk w join e on e.source = w.descendant)
    select ancestor, descendant, cast(min(distance) as int) as distance from walk group by 1, 2""")
def lineage_reachability(spark: SparkSession, d: str) -> DataFrame:
    """Every table with all it depends on, and how far away."""
    return reachable(spark.createDataFrame(list(EDGES), "source string, target string"))


@query("select dataset, status, cast(count(*) as bigint) as files, cast(count(distinct sha256) as bigint) as contents, cast(sum(rows_read) as bigint) as rows_read, cast(sum(rows_corrupt) as bigint) as rows_corrupt, cast(sum(size_bytes) as bigint) as bytes, max(loaded_at) as last_loaded from ops_file_loads group by 1, 2")
def file_load_rollup(spark: SparkSession, d: str) -> DataFrame:
    """File loads per dataset and status."""
    t = table(spark, d, "ops_file_loads")
    return t.groupBy("dataset", "status").agg(F.count("*").alias("files"), F.count_distinct("sha256").alias("contents"), *[F.sum(c).alias(a) for c, a in (("rows_read", "rows_read"), ("rows_corrupt", "rows_corrupt"), ("size_bytes", "bytes"))], F.max("loaded_at").alias("last_loaded"))


_CATALOG = ("slv_orders", "slv_order_items", "brz_payments", "gld_daily_sales", "gld_delivery_metrics", "gld_demand_predictions", "gld_quality_summary", "ops_file_loads", "ops_quarantine_summary", "products", "stores")


@query(" union all ".join(f"select '{t}' as table_name, case when starts_with('{t}', 'slv_') then 'silver' when starts_with('{t}', 'brz_') then 'bronze' when starts_with('{t}', 'gld_') then 'gold' when starts_with('{t}', 'ops_') then 'ops' else 'dimension' end as layer, cast(count(*) as bigint) as n_rows from {t}" for t in _CATALOG))
def table_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Every published table with its layer and rows (from Parquet footers)."""
    parts = [table(spark, d, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in _CATALOG]
    return reduce(DataFrame.unionByName, parts).select("table_name", layer(F.col("table_name")).alias("layer"), "n_rows")


@query("select dataset, file_name, load_id, status, loaded_at from (select *, row_number() over (partition by dataset, file_name order by loaded_at desc nulls last, load_id desc) as n from ops_file_loads where dataset is not null and file_name is not null) where n = 1")
def latest_load_per_file(spark: SparkSession, d: str) -> DataFrame:
    """The last load of every file."""
    w = W.partitionBy("dataset", "file_name").orderBy(F.desc_nulls_last("loaded_at"), F.desc("load_id"))
    t = table(spark, d, "ops_file_loads").where("dataset is not null and file_name is not null")
    return t.withColumn("n", F.row_number().over(w)).where("n = 1").select("dataset", "file_name", "load_id", "status", "loaded_at")


@query("select run_id, started, ended, date_diff('second', started, ended) as seconds, files, failed, median(date_diff('second', started, ended)) over () as median_seconds from (select run_id, min(loaded_at) as started, max(loaded_at) as ended, cast(count(*) as bigint) as files, cast(count(*) filter (status = 'failed') as bigint) as failed from ops_file_loads where run_id is not null group by 1)")
def run_durations(spark: SparkSession, d: str) -> DataFrame:
    """How long every run loaded files, with the median of all."""
    g = table(spark, d, "ops_file_loads").where("run_id is not null").groupBy("run_id").agg(F.min("loaded_at").alias("started"), F.max("loaded_at").alias("ended"), F.count("*").alias("files"), F.count_if(F.col("status") == "failed").alias("failed"))
    s = F.unix_seconds(F.col("ended").cast("timestamp")) - F.unix_seconds(F.col("started").cast("timestamp"))
    g = g.withColumn("seconds", s)
    return g.join(F.broadcast(g.agg(F.median("seconds").alias("median_seconds"))))  # one row
