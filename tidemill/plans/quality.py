"""The engine's own tables checked: copies, rolling totals, rejects, orphans and profiles, each as a named query with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.keys import norm_key
from tidemill.operators import copies, orphans, profile, rejects, rolling
from tidemill.operators.profile import Profiled
from tidemill.operators.rejects import Cell
from tidemill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- 1: messages delivered more than once ---------------------------------------------------------------------------


def payment_key() -> Column:
    """Identity of a payment message: its payment_id, else its record hash."""
    return F.coalesce(F.concat(F.lit("id "), norm_key(F.col("payment_id"))), F.concat(F.lit("hash "), norm_key(F.col("_record_hash"))))


def file_key() -> Column:
    """Identity of a loaded file: dataset and content hash; null for loads that do not count."""
    return F.when(F.col("status") == "loaded", F.concat(norm_key(F.col("dataset")), F.lit(" "), norm_key(F.col("sha256"))))


_PAYMENT_KEY = "coalesce('id ' || upper(trim(payment_id)), 'hash ' || upper(trim(_record_hash)))"
_FILE_KEY = "case when status = 'loaded' then upper(trim(dataset)) || ' ' || upper(trim(sha256)) end"


@query(f"""
    select table_name, row_id from (
      select 'brz_payments' as table_name, row_id, row_number() over (partition by {_PAYMENT_KEY} order by _ingestion_ts nulls last, row_id) as n
      from brz_payments where {_PAYMENT_KEY} is not null
      union all
      select 'ops_file_loads', load_id, row_number() over (partition by {_FILE_KEY} order by loaded_at nulls last, load_id)
      from ops_file_loads where {_FILE_KEY} is not null
    ) where n > 1""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The surplus copies of brz_payments and ops_file_loads."""
    payments = copies.surplus_copies(table(spark, d, "brz_payments"), payment_key(), "_ingestion_ts", "row_id")
    files = copies.surplus_copies(table(spark, d, "ops_file_loads"), file_key(), "loaded_at", "load_id")
    return payments.select(F.lit("brz_payments").alias("table_name"), "row_id").unionByName(files.select(F.lit("ops_file_loads").alias("table_name"), "row_id"))


@query(f"""
    select row_id, payment_id, order_id, attempt_no, method, amount, status, payment_ts, _source_file, _bronze_batch_id, _record_hash, _ingestion_ts
    from (select *, row_number() over (partition by {_PAYMENT_KEY} order by _ingestion_ts nulls last, row_id) as n from brz_payments)
    where n = 1 or {_PAYMENT_KEY} is null""")
def p1_payments_once(spark: SparkSession, d: str) -> DataFrame:
    """brz_payments with exactly one copy of each message, whole rows."""
    return copies.keep_one(table(spark, d, "brz_payments"), payment_key(), ["_ingestion_ts", "row_id"])


@query(f"""
    select _bronze_batch_id as batch, cast(sum(n) as bigint) as rows, cast(count(*) as bigint) as messages, cast(sum(n) - count(*) as bigint) as surplus
    from (select _bronze_batch_id, {_PAYMENT_KEY} as k, count(*) as n from brz_payments group by 1, 2) group by 1""")
def p1_copies_per_batch(spark: SparkSession, d: str) -> DataFrame:
    """Rows, messages and surplus copies inside each batch of brz_payments."""
    return copies.copy_accounting(table(spark, d, "brz_payments"), payment_key(), "_ingestion_ts", "row_id", F.col("_bronze_batch_id")).withColumnRenamed("group", "batch")


@query(f"""
    select _bronze_batch_id as batch, cast(count(*) as bigint) as rows, cast(count(*) filter (where k is null or n = 1) as bigint) as messages, cast(count(*) filter (where k is not null and n > 1) as bigint) as surplus
    from (select _bronze_batch_id, {_PAYMENT_KEY} as k, row_number() over (partition by {_PAYMENT_KEY} order by _ingestion_ts nulls last, row_id) as n from brz_payments) group by 1""")
def p1_surplus_per_batch(spark: SparkSession, d: str) -> DataFrame:
    """Rows, kept messages and surplus copies of each batch of brz_payments, copies within and across batches."""
    return copies.surplus_accounting(table(spark, d, "brz_payments"), payment_key(), "_ingestion_ts", "row_id", F.col("_bronze_batch_id")).withColumnRenamed("group", "batch")


# --- 2: rolling totals over trailing periods ------------------------------------------------------------------------

_PREDICTION_KEY = "upper(trim(store_id)) as s, upper(trim(category_id)) as c"


@query(f"""
    with v as (select {_PREDICTION_KEY}, forecast_date as d, max(actual_units) as u from gld_demand_predictions group by 1, 2, 3),
    asked as (select distinct {_PREDICTION_KEY}, origin_date as o from gld_demand_predictions where baseline_moving_avg is not null and origin_date is not null),
    m as (select a.s, a.c, a.o, coalesce(sum(v.u), 0) / 7.0 as mean from asked a left join v on v.s = a.s and v.c = a.c and v.d > a.o - 7 and v.d <= a.o group by 1, 2, 3)
    select store_id, category_id, strftime(forecast_date, '%Y-%m-%d') as forecast_date, strftime(origin_date, '%Y-%m-%d') as origin_date
    from gld_demand_predictions p join m on m.s = upper(trim(p.store_id)) and m.c = upper(trim(p.category_id)) and m.o = p.origin_date
    where abs(baseline_moving_avg - mean) > 0.01""")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Predictions whose moving-average baseline is not the mean of the 7 days up to the origin."""
    rows = table(spark, d, "gld_demand_predictions").select(
        "store_id", "category_id", "forecast_date", "origin_date", "actual_units", "baseline_moving_avg", norm_key(F.col("store_id")).alias("s"), norm_key(F.col("category_id")).alias("c")
    )
    wrong = rolling.check_moving_average(rows, ["s", "c"], "forecast_date", "origin_date", "actual_units", "baseline_moving_avg")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return wrong.select("store_id", "category_id", day("forecast_date"), day("origin_date"))


def _rolling_sql(source: str, prefix: str, kind: str) -> str:
    sums = ", ".join(f"cast(sum(coalesce(v, 0)) over (partition by store_id order by business_date rows between {p - 1} preceding and current row) as {kind}) as {prefix}_sum_{p}" for p in (7, 30))
    avgs = ", ".join(f"round(cast({prefix}_sum_{p} as double) / {p}, 6) as {prefix}_avg_{p}" for p in (7, 30))
    return f"""
    with daily as ({source}),
    days as (select cast(unnest(generate_series(min(business_date), max(business_date), interval 1 day)) as date) as business_date from daily),
    grid as (select s.store_id, d.business_date, v from (select distinct store_id from daily) s cross join days d left join daily x on x.store_id = s.store_id and x.business_date = d.business_date),
    w as (select store_id, business_date, {sums} from grid)
    select *, {avgs} from w"""


@query(
    _rolling_sql(
        """select store_id, business_date, v from (
             select upper(trim(store_id)) as store_id, business_date, net_revenue as v,
               row_number() over (partition by upper(trim(store_id)), business_date order by published_at desc nulls last, net_revenue desc nulls last) as n
             from gld_daily_sales where store_id is not null and business_date is not null) where n = 1""",
        "net_revenue",
        "decimal(38,2)",
    )
)
def p2_rolling_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Net revenue over the trailing 7 and 30 days per store and calendar day; the latest publication of a day counts."""
    sales = table(spark, d, "gld_daily_sales").select(norm_key(F.col("store_id")).alias("store_id"), "business_date", "net_revenue", "published_at").where("store_id is not null and business_date is not null")
    latest = F.max_by(F.struct("net_revenue"), F.struct("published_at", "net_revenue")).getField("net_revenue")
    daily = rolling.daily_values(sales, ["store_id"], "business_date", {"net_revenue": latest})
    return _whole_calendar(daily, {"net_revenue": "net_revenue"}, "decimal(38,2)")


@query(
    _rolling_sql(
        "select upper(trim(store_id)) as store_id, business_date, max(deliveries) as v from gld_delivery_metrics where store_id is not null and business_date is not null group by 1, 2",
        "deliveries",
        "bigint",
    )
)
def p2_rolling_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries over the trailing 7 and 30 days per store and calendar day; repeated rows of a store-day count once."""
    rows = table(spark, d, "gld_delivery_metrics").select(norm_key(F.col("store_id")).alias("store_id"), "business_date", "deliveries").where("store_id is not null and business_date is not null")
    daily = rolling.daily_values(rows, ["store_id"], "business_date", {"deliveries": F.max("deliveries")})
    return _whole_calendar(daily, {"deliveries": "deliveries"}, "bigint")


#: The columns of gld_delivery_metrics that add up over days (active_partners to partner days). Rates, means and percentiles do not.
_DELIVERY_MEASURES = ("deliveries", "delivered", "failed", "cancelled_in_transit", "active_partners")


def _delivery_measures_sql() -> str:
    over = "over (partition by store_id order by business_date rows between {} preceding and current row)"
    sums = ", ".join(f"cast(sum(coalesce({m}, 0)) {over.format(p - 1)} as bigint) as {m}_sum_{p}" for m in _DELIVERY_MEASURES for p in (7, 30))
    avgs = ", ".join(f"round(cast({m}_sum_{p} as double) / {p}, 6) as {m}_avg_{p}" for m in _DELIVERY_MEASURES for p in (7, 30))
    return f"""
    with daily as (select upper(trim(store_id)) as store_id, business_date, {", ".join(f"max({m}) as {m}" for m in _DELIVERY_MEASURES)} from gld_delivery_metrics where store_id is not null and business_date is not null group by 1, 2),
    days as (select cast(unnest(generate_series(min(business_date), max(business_date), interval 1 day)) as date) as business_date from daily),
    grid as (select s.store_id, d.business_date, {", ".join(_DELIVERY_MEASURES)} from (select distinct store_id from daily) s cross join days d left join daily x on x.store_id = s.store_id and x.business_date = d.business_date),
    w as (select store_id, business_date, {sums} from grid)
    select *, {avgs} from w"""


@query(_delivery_measures_sql())
def p2_rolling_delivery_measures(spark: SparkSession, d: str) -> DataFrame:
    """All additive delivery measures over the trailing 7 and 30 days per store and calendar day; repeated rows of a store-day count once."""
    rows = table(spark, d, "gld_delivery_metrics").select(norm_key(F.col("store_id")).alias("store_id"), "business_date", *_DELIVERY_MEASURES).where("store_id is not null and business_date is not null")
    daily = rolling.daily_values(rows, ["store_id"], "business_date", {m: F.max(m) for m in _DELIVERY_MEASURES})
    return _whole_calendar(daily, {m: m for m in _DELIVERY_MEASURES}, "bigint")


def _whole_calendar(daily: DataFrame, values: dict[str, str], kind: str) -> DataFrame:
    """rolling_totals with every store's calendar running from the first to the last day of the table (a one-row aggregate)."""
    bounds = daily.agg(F.min("business_date").alias("__from"), F.max("business_date").alias("__to"))
    with_bounds = daily.join(F.broadcast(bounds))  # one row
    out = rolling.rolling_totals(with_bounds, ["store_id"], "business_date", values, (7, 30), F.col("__from"), F.col("__to"))
    totals = [F.col(f"{p}_sum_{n}").cast(kind).alias(f"{p}_sum_{n}") for p in values.values() for n in (7, 30)]
    return out.select("store_id", "business_date", *totals, *[F.round(f"{p}_avg_{n}", 6).alias(f"{p}_avg_{n}") for p in values.values() for n in (7, 30)])


# --- 3: rows that fail to parse -------------------------------------------------------------------------------------

#: The layouts of the landing datasets.
LAYOUTS = {
    "application_logs": [
        Cell("log_id", pattern=r"LOG\d{9}"),
        Cell("event_ts", "timestamp"),
        Cell("service", values=("order-service", "payment-service", "inventory-service", "delivery-service", "search-service")),
        Cell("log_level", values=("INFO", "WARN", "ERROR", "DEBUG"), any_case=True),
        Cell("message"),
    ],
    "inventory_events": [
        Cell("event_id", pattern=r"IE\d{9}"),
        Cell("store_id", pattern=r"S\d{6}"),
        Cell("product_id", pattern=r"P\d{4}"),
        Cell("event_type", values=("restock", "damage", "adjustment"), any_case=True),
        Cell("quantity", "int", pattern=r"[+-]?\d+"),
        Cell("event_ts", "timestamp"),
    ],
}

_CELL_SQL = """(?:"[^"]*(?:""[^"]*)*"|(?:[^",][^,]*)?)"""
_TS_SQL = r"""coalesce(
      try_strptime(case when regexp_full_match({0}, '\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\dZ') then {0} end, '%Y-%m-%dT%H:%M:%SZ'),
      try_strptime(case when regexp_full_match({0}, '\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00') then {0} end, '%Y-%m-%dT%H:%M:%S+00:00'),
      try_strptime(case when regexp_full_match({0}, '\d\d/\d\d/\d{{4}} \d\d:\d\d:\d\d') then {0} end, '%d/%m/%Y %H:%M:%S'),
      try_strptime(case when regexp_full_match({0}, '\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d') then {0} end, '%Y-%m-%d %H:%M:%S'),
      try_strptime(case when regexp_full_match({0}, '\d{{4}}/\d\d/\d\d \d\d:\d\d:\d\d') then {0} end, '%Y/%m/%d %H:%M:%S'))"""
_PARSED_SQL = rf"""
    raw as (select line_id, dataset, coalesce(_corrupt_record, '') as t from landing_rows),
    split as (select *, regexp_full_match(t, '(?s){_CELL_SQL}(?:,{_CELL_SQL})*') as quoted,
                list_transform(regexp_extract_all(',' || t, '(?s),({_CELL_SQL})', 1),
                  lambda c: trim(case when starts_with(c, '"') then replace(c[2:-2], '""', '"') else c end, ' ')) as v from raw)"""
_VALID_SQL = rf"""case dataset
      when 'application_logs' then len(v) = 5 and regexp_full_match(v[1], 'LOG\d{{9}}') and {_TS_SQL.format("v[2]")} is not null
        and v[3] in ('order-service', 'payment-service', 'inventory-service', 'delivery-service', 'search-service') and upper(v[4]) in ('INFO', 'WARN', 'ERROR', 'DEBUG') and v[5] <> ''
      when 'inventory_events' then len(v) = 6 and regexp_full_match(v[1], 'IE\d{{9}}') and regexp_full_match(v[2], 'S\d{{6}}') and regexp_full_match(v[3], 'P\d{{4}}')
        and upper(v[4]) in ('RESTOCK', 'DAMAGE', 'ADJUSTMENT') and regexp_full_match(v[5], '[+-]?\d+') and try_cast(v[5] as int) is not null and {_TS_SQL.format("v[6]")} is not null
      else false end"""


@query(f"""
    with {_PARSED_SQL}
    select line_id, case when not quoted then 'quoting' when len(v) <> case dataset when 'application_logs' then 5 when 'inventory_events' then 6 else -1 end then 'column_count' else 'invalid_value' end as reason
    from split where not quoted or not ({_VALID_SQL})""")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rejected landing rows with the first reason that holds."""
    return rejects.rejected_rows(table(spark, d, "landing_rows"), LAYOUTS).select("line_id", "reason")


@query(f"""
    with {_PARSED_SQL}
    select line_id, v[1] as log_id, {_TS_SQL.format("v[2]")} as event_ts, v[3] as service, v[4] as log_level, v[5] as message
    from split where dataset = 'application_logs' and quoted and {_VALID_SQL}""")
def p3_application_logs(spark: SparkSession, d: str) -> DataFrame:
    """The valid application_logs rows, typed."""
    raw = table(spark, d, "landing_rows").where("dataset = 'application_logs'")
    return rejects.strict_load(raw, LAYOUTS["application_logs"], "_corrupt_record", "line_id").withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))


@query(f"""
    with {_PARSED_SQL}
    select line_id, v[1] as event_id, v[2] as store_id, v[3] as product_id, v[4] as event_type, cast(v[5] as int) as quantity, {_TS_SQL.format("v[6]")} as event_ts
    from (select * from split where dataset = 'inventory_events' and quoted and {_VALID_SQL})""")
def p3_inventory_events(spark: SparkSession, d: str) -> DataFrame:
    """The valid inventory_events rows, typed."""
    raw = table(spark, d, "landing_rows").where("dataset = 'inventory_events'")
    return rejects.strict_load(raw, LAYOUTS["inventory_events"], "_corrupt_record", "line_id").withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))


@query(f"""
    with {_PARSED_SQL},
    bad as (select line_id, case when not quoted then 'quoting' when len(v) <> case dataset when 'application_logs' then 5 when 'inventory_events' then 6 else -1 end then 'column_count' else 'invalid_value' end as reason
      from split where not quoted or not ({_VALID_SQL}))
    select r.dataset, r._source_file as source_file, cast(count(*) as bigint) as rows_read, cast(count(b.line_id) as bigint) as rows_corrupt,
      cast(count(*) filter (reason = 'quoting') as bigint) as quoting, cast(count(*) filter (reason = 'column_count') as bigint) as column_count, cast(count(*) filter (reason = 'invalid_value') as bigint) as invalid_value
    from landing_rows r left join bad b using (line_id) group by 1, 2""")
def p3_file_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per file: rows read, rows rejected, and rejected by reason."""
    raw = table(spark, d, "landing_rows")
    read = raw.groupBy("dataset", F.col("_source_file").alias("source_file")).agg(F.count("*").alias("rows_read"), *[F.lit(0).cast("bigint").alias(r) for r in ("quoting", "column_count", "invalid_value")])
    bad = rejects.rejected_rows(raw, LAYOUTS).select("line_id", "reason").join(raw.select("line_id", "dataset", F.col("_source_file").alias("source_file")), "line_id")
    bad = bad.groupBy("dataset", "source_file").agg(F.lit(0).cast("bigint").alias("rows_read"), *[F.count_if(F.col("reason") == r).alias(r) for r in ("quoting", "column_count", "invalid_value")])
    both = read.unionByName(bad).groupBy("dataset", "source_file").agg(*[F.sum(c).alias(c) for c in ("rows_read", "quoting", "column_count", "invalid_value")])
    return both.withColumn("rows_corrupt", F.col("quoting") + F.col("column_count") + F.col("invalid_value"))


# --- 4: references to records that do not exist ---------------------------------------------------------------------

#: The references that fk_specs lists, for the SQL side.
_SPEC_SQL = [("slv_order_items", "order_id", "slv_orders", "order_id"), ("slv_order_items", "product_id", "products", "product_id"), ("slv_orders", "store_id", "stores", "store_id"), ("brz_payments", "order_id", "slv_orders", "order_id")]


def _orphans_sql() -> str:
    parts = [
        f"""select '{ct}' as child_table, '{cc}' as child_column, c.row_id, c._ingestion_ts as arrived,
          case when p.k is null then 'missing' when p.until <= c._ingestion_ts then 'deleted' when p.since > c._ingestion_ts then 'late' end as kind
        from {ct} c left join (select upper(trim({pc})) as k, min(_ingestion_ts) as since, case when count(*) = count(_deleted_at) then max(_deleted_at) end as until from {pt} where {pc} is not null group by 1) p
          on p.k = upper(trim(c.{cc})) where c.{cc} is not null"""
        for ct, cc, pt, pc in _SPEC_SQL
    ]
    return "(" + " union all ".join(parts) + ") where kind is not null"


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    """The orphans of every reference that fk_specs lists; the list itself is configuration and read by the driver."""
    specs = table(spark, d, "fk_specs").select("child_table", "child_column", "parent_table", "parent_column").distinct().sort("child_table", "child_column").collect()
    children: dict[str, list[orphans.ForeignKey]] = {}
    for s in specs:
        children.setdefault(s.child_table, []).append(orphans.ForeignKey(s.child_column, table(spark, d, s.parent_table), s.parent_column))
    parts = [orphans.orphan_references(table(spark, d, name), keys).select(F.lit(name).alias("child_table"), "child_column", "row_id", "arrived", "kind") for name, keys in children.items()]
    none = spark.createDataFrame([], "child_table string, child_column string, row_id bigint, arrived timestamp_ntz, kind string")
    return reduce(DataFrame.unionByName, parts) if parts else none


@query(f"select child_table, child_column, row_id, kind from {_orphans_sql()}")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per orphan reference of fk_specs."""
    return _orphans(spark, d).select("child_table", "child_column", "row_id", "kind")


@query(f"select child_table, child_column, cast(arrived as date) as arrived_on, kind, cast(count(*) as bigint) as n_rows from {_orphans_sql()} group by 1, 2, 3, 4")
def p4_orphans_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, column, day of arrival and kind."""
    return orphans.orphan_counts(_orphans(spark, d), ["child_table", "child_column"])


# --- 5: column-level data quality profile ---------------------------------------------------------------------------

PROFILED = {
    "slv_order_items": (
        "_bronze_batch_id",
        [
            Profiled("order_item_id", pattern=r"OI\d{10}", dominance=False),
            Profiled("order_id", pattern=r"ORD\d{9}", dominance=False),
            Profiled("product_id", pattern=r"P\d{4}"),
            Profiled("quantity", low=1, high=100),
            Profiled("unit_price", low=0.01, high=5000),
        ],
    ),
    "gld_quality_summary": (
        "silver_run_id",
        [Profiled("rows_affected", low=0), Profiled("affected_pct", low=0, high=100), Profiled("outcome", pattern="removed|fixed|quarantined|cascade|flagged")],
    ),
}


def _each_profiled(f: Callable[[DataFrame, str, list[Profiled]], DataFrame], spark: SparkSession, d: str) -> DataFrame:
    parts = [f(table(spark, d, t), load, columns).select(F.lit(t).alias("table_name"), "*") for t, (load, columns) in PROFILED.items()]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("load", "load_key")


def _profile_sql() -> str:
    parts = []
    for t, (load, columns) in PROFILED.items():
        for p in columns:
            odd = f"not regexp_full_match({p.name}, '{p.pattern}')" if p.pattern else " or ".join([f"{p.name} < {p.low}"] * (p.low is not None) + [f"{p.name} > {p.high}"] * (p.high is not None))
            inside = f"case when not ({odd}) then cast({p.name} as double) end" if not p.pattern else "cast(null as double)"
            parts.append(f"""
        select '{t}' as table_name, load_key, '{p.name}' as column_name, {str(p.dominance).lower()} as dom, {str(bool(p.pattern)).lower()} as pat, sum(n) as rows, sum(n) filter (v is not null) as filled,
          count(*) filter (v is not null) as distincts, max(n) filter (v is not null) as top, sum(n) filter (odd) as odd, sum(n) filter (x is not null) as inside, sum(n * x) as inside_sum
        from (select {load} as load_key, {p.name} as v, any_value({odd}) as odd, any_value({inside}) as x, count(*) as n from {t} group by 1, 2) group by 1, 2, 3""")
    return f"""
    base as ({" union all ".join(parts)}),
    prof as (select *, coalesce(rows - filled, rows) / rows as null_share, top / filled as top_share, coalesce(odd, 0) / filled as odd_share, inside_sum / inside as inside_mean,
      (sum(rows) over w - sum(coalesce(filled, 0)) over w) / sum(rows) over w as all_null_share, sum(coalesce(odd, 0)) over w / sum(filled) over w as all_odd_share,
      sum(inside_sum) over w / sum(inside) over w as all_inside_mean
      from base window w as (partition by table_name, column_name))"""


@query(f"""
    with {_profile_sql()}
    select table_name, load_key, column_name, unnest(list_filter([case when null_share - all_null_share > 0.10 then 'nulls' end, case when pat and odd_share - all_odd_share > 0.10 then 'pattern' end,
      case when not pat and odd_share - all_odd_share > 0.10 then 'range' end, case when not pat and (inside_mean > all_inside_mean * 1.5 or inside_mean < all_inside_mean / 1.5) then 'distribution' end,
      case when dom and top_share > 0.5 then 'dominance' end], lambda a: a is not null)) as aspect from prof where load_key is not null""")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Loads whose columns stand out from the whole table."""
    return _each_profiled(lambda df, load, columns: profile.remarkable(profile.column_profile(df, load, columns), columns), spark, d)


@query(f"""
    with {_profile_sql()}
    select table_name, load_key, column_name, cast(rows as bigint) as rows, cast(coalesce(filled, 0) as bigint) as filled, cast(distincts as bigint) as distinct_values, round(null_share, 9) as null_share,
      round(top_share, 9) as top_share, round(odd_share, 9) as odd_share, round(inside_mean, 6) as inside_mean from prof""")
def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """Null share, distinct count, top share, violations and mean of every load's columns."""
    shown = ["load", "column_name", "rows", "filled", F.col("distinct").alias("distinct_values"), *[F.round(c, 9).alias(c) for c in ("null_share", "top_share", "odd_share")], F.round("inside_mean", 6).alias("inside_mean")]
    return _each_profiled(lambda df, load, columns: profile.column_profile(df, load, columns).select(*shown), spark, d)


_QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def _each_column_sql(part: Callable[[str, str, Profiled], str]) -> str:
    return " union all ".join(f"({part(t, load, p)})" for t, (load, columns) in PROFILED.items() for p in columns)


def _quantiles_sql(t: str, load: str, p: Profiled) -> str:
    value = p.name if p.pattern else f"cast({p.name} as double)"
    return f"""select '{t}' as table_name, load_key, '{p.name}' as column_name, unnest([{", ".join(f"cast({q} as double)" for q in _QUANTILES)}]) as q, cast(unnest(values) as varchar) as value
        from (select {load} as load_key, quantile_disc({value}, [{", ".join(map(str, _QUANTILES))}]) as values from {t} where {p.name} is not null group by 1)"""


def _drift_sql(t: str, load: str, p: Profiled) -> str:
    return f"""select '{t}' as table_name, load_key, previous, '{p.name}' as column_name, round(max(abs(fa - fb)), 6) as ks from (
        select load_key, previous, sum(a) over w / sum(a) over (partition by load_key) as fa, sum(b) over w / sum(b) over (partition by load_key) as fb from (
          select pairs.load_key, previous, v, sum(case when c.l = pairs.load_key then n else 0 end) as a, sum(case when c.l = previous then n else 0 end) as b
          from (select l as load_key, lag(l) over (order by l) as previous from (select distinct {load} as l from {t} where {load} is not null and {p.name} is not null)) pairs
          join (select {load} as l, {p.name} as v, count(*) as n from {t} where {p.name} is not null group by 1, 2) c on c.l = pairs.load_key or c.l = previous where previous is not null group by 1, 2, 3)
        window w as (partition by load_key order by v)) group by 2, 3"""


@query(_each_column_sql(_quantiles_sql))
def p5_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of every load's columns, values as text."""
    return _each_profiled(lambda df, load, columns: profile.load_quantiles(df, load, columns, _QUANTILES), spark, d)


@query(_each_column_sql(_drift_sql))
def p5_drift(spark: SparkSession, d: str) -> DataFrame:
    """Exact Kolmogorov-Smirnov distance of every load's columns to the load before."""
    return _each_profiled(profile.load_drift, spark, d).withColumn("ks", F.round("ks", 6))
