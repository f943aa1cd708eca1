"""The order tables through their contracts, and the single steps of ingestion and validation as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.operators import bronze, contracts
from tidemill.operators.contracts import Check, Contract, Field, Outcome, Reference, in_range
from tidemill.operators.rejects import instant
from tidemill.plans.registry import Registry
from tidemill.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: The allowed words of the order tables.
ORDER_STATUS = ("delivered", "cancelled")
PAYMENT_METHOD = ("upi", "card", "wallet", "cod")
PAYMENT_STATUS = ("success", "failed", "voided", "cancelled")

ORDERS = Contract(
    "orders",
    ("order_id",),
    (Field("order_id", style="upper"), Field("customer_id", style="upper"), Field("store_id", style="upper"), Field("order_ts", "timestamp"), Field("status", style="lower", values=ORDER_STATUS), Field("total_amount", "decimal(12,2)")),
    (in_range("total_amount", 0), Check("business:large_total", lambda: F.col("total_amount") > 2000, hard=False)),
    (Reference("store_id", "stores", "store_id"),),
    event="order_ts",
)
ITEMS = Contract(
    "order_items",
    ("order_item_id",),
    (Field("order_item_id", style="upper"), Field("order_id", style="upper"), Field("product_id", style="upper"), Field("quantity", "int"), Field("unit_price", "decimal(12,2)")),
    (in_range("quantity", 1, 100), in_range("unit_price", 0, open_low=True)),
    (Reference("order_id", "orders", "order_id"), Reference("product_id", "products", "product_id")),
    derive={"line_amount": lambda: (F.col("quantity") * F.col("unit_price")).cast("decimal(18,2)")},
)
PAYMENTS = Contract(
    "payments",
    ("payment_id",),
    (
        Field("payment_id", style="upper"),
        Field("order_id", style="upper"),
        Field("attempt_no", "int"),
        Field("method", style="lower", values=PAYMENT_METHOD),
        Field("amount", "decimal(12,2)"),
        Field("status", style="lower", values=PAYMENT_STATUS),
        Field("payment_ts", "timestamp"),
    ),
    (in_range("amount", 0),),
    (Reference("order_id", "orders", "order_id"),),
    event="payment_ts",
)


def outcomes(spark: SparkSession, d: str) -> dict[str, Outcome]:
    """The three datasets in the order of their references."""
    t = lambda n: table(spark, d, n)
    # Timestamps that are typed already are written as text in one of the accepted layouts, so one path checks all.
    orders = contracts.settled(contracts.check(t("slv_orders").withColumn("order_ts", F.date_format("order_ts", "yyyy-MM-dd HH:mm:ss")), ORDERS, {"stores": t("stores")}), "orders")
    items = contracts.check(t("slv_order_items"), ITEMS, {"orders": orders, "products": t("products")})
    payments = contracts.check(t("brz_payments"), PAYMENTS, {"orders": orders})
    return {"orders": orders, "order_items": items, "payments": payments}


_TS = r"""coalesce(try_strptime(case when regexp_full_match({0}, '\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|\+00:00)') then {0}[:19] end, '%Y-%m-%dT%H:%M:%S'), try_strptime(case when regexp_full_match({0}, '\d\d/\d\d/\d{{4}} \d\d:\d\d:\d\d') then {0} end, '%d/%m/%Y %H:%M:%S'),
      try_strptime(case when regexp_full_match({0}, '\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d') then {0} end, '%Y-%m-%d %H:%M:%S'), try_strptime(case when regexp_full_match({0}, '\d{{4}}/\d\d/\d\d \d\d:\d\d:\d\d') then {0} end, '%Y/%m/%d %H:%M:%S'))"""


def _contract_sql(c: Contract, source: str, parents: dict[str, str], raw: dict[str, str] | None = None) -> str:
    """CTEs {dataset}_checked: the surviving rows of a contract with their failures, in SQL. `raw`: how a column becomes text."""
    text = {f.name: (raw or {}).get(f.name, f.name) for f in c.fields}
    std = lambda f: {"upper": "upper({})", "lower": "lower({})"}.get(f.style or "", "{}").format(f"nullif(trim(cast({text[f.name]} as varchar), ' '), '')")
    kind = lambda f: (_TS.format(f"std_{f.name}") if f.type == "timestamp" else f"try_cast(case when regexp_full_match(std_{f.name}, '[+-]?\\d+') then std_{f.name} end as int)" if f.type == "int" else f"try_cast(std_{f.name} as {f.type})" if f.type != "string" else f"std_{f.name}")
    checks = []
    for f in c.fields:
        checks += [(f"required_missing:{f.name}", f"std_{f.name} is null")] * f.required
        checks += [(f"type_invalid:{f.name}", f"std_{f.name} is not null and {f.name} is null")] * (f.type != "string")
        checks += [(f"enum_invalid:{f.name}", f"{f.name} not in {f.values}")] * bool(f.values)
    ranges = {"orders": [("total_amount", "total_amount < 0")], "order_items": [("quantity", "quantity < 1 or quantity > 100"), ("unit_price", "unit_price <= 0")], "payments": [("amount", "amount < 0")]}
    checks += [(f"range_invalid:{n}", e) for n, e in ranges[c.dataset]]
    joins = ""
    for i, r in enumerate(c.references):
        joins += f" left join ({parents[r.parent]}) p{i} on p{i}.k = x.{r.column}"
        checks += [(f"fk_missing:{r.column}", f"x.{r.column} is not null and p{i}.ok is null"), (f"parent_rejected:{r.parent}", f"x.{r.column} is not null and not p{i}.ok")]
    checks.sort(key=lambda k: contracts.PRIORITY.index(k[0].split(":")[0]))
    array = ", ".join(f"case when {e} then '{n}' end" for n, e in checks)
    key = c.key[0]
    order = ", ".join(f"{x} desc nulls last" for x in (c.arrival, c.event, c.row_id) if x)
    return f"""
    {c.dataset}_std as (select {c.row_id}, {c.arrival}, {", ".join(f"cast({text[f.name]} as varchar) as raw_{f.name}, {std(f)} as std_{f.name}" for f in c.fields)} from {source}),
    {c.dataset}_typed as (select *, {", ".join(f"{kind(f)} as {f.name}" for f in c.fields)} from {c.dataset}_std),
    {c.dataset}_last as (select *, row_number() over (partition by {key} order by {order}) as n, count(*) over (partition by {key}) as n_copies from {c.dataset}_typed),
    {c.dataset}_checked as (select x.*, list_filter([{array}], lambda f: f is not null) as failures from {c.dataset}_last x{joins} where {key} is null or n = 1)"""


_OUTCOME = "(select std_order_id as k, bool_or(len(failures) = 0) as ok from orders_checked where std_order_id is not null group by 1)"
_ALL_SQL = ",".join(
    [
        _contract_sql(ORDERS, "slv_orders", {"stores": "select distinct upper(nullif(trim(store_id, ' '), '')) as k, true as ok from stores"}, {"order_ts": "strftime(order_ts, '%Y-%m-%d %H:%M:%S')"}),
        _contract_sql(ITEMS, "slv_order_items", {"orders": f"select * from {_OUTCOME}", "products": "select distinct upper(nullif(trim(product_id, ' '), '')) as k, true as ok from products"}),
        _contract_sql(PAYMENTS, "brz_payments", {"orders": f"select * from {_OUTCOME}"}),
    ]
)
_CASCADE = "len(list_filter(failures, lambda f: not starts_with(f, 'parent_rejected'))) = 0"


@query(f"with {_ALL_SQL} select row_id, order_id, customer_id, store_id, order_ts, status, total_amount, total_amount > 2000 as dq_large_total from orders_checked where len(failures) = 0")
def silver_orders(spark: SparkSession, d: str) -> DataFrame:
    """Valid orders: one per order id, typed, with the soft flag."""
    return outcomes(spark, d)["orders"].valid.withColumn("order_ts", F.col("order_ts").cast("timestamp_ntz"))


@query(f"with {_ALL_SQL} select row_id, order_item_id, order_id, product_id, quantity, unit_price, cast(quantity * unit_price as decimal(18,2)) as line_amount from order_items_checked where len(failures) = 0")
def silver_order_items(spark: SparkSession, d: str) -> DataFrame:
    """Valid order lines, with the derived line amount."""
    return outcomes(spark, d)["order_items"].valid


@query(f"with {_ALL_SQL} select row_id, payment_id, order_id, attempt_no, method, amount, status, payment_ts from payments_checked where len(failures) = 0")
def silver_payments(spark: SparkSession, d: str) -> DataFrame:
    """Valid payments."""
    return outcomes(spark, d)["payments"].valid.withColumn("payment_ts", F.col("payment_ts").cast("timestamp_ntz"))


_QUARANTINE_SQL = " union all ".join(
    f"select '{c.dataset}' as source_dataset, row_id, '{c.key[0]}=' || coalesce(std_{c.key[0]}, '') as source_record_id, array_to_string(failures, '|') as failed_rules, failures[1] as primary_rule, case when {_CASCADE} then 'warning' else 'error' end as severity, case when {_CASCADE} then 'cascade' else 'direct' end as rejection_type, cast(to_json(struct_pack({', '.join(f'{f.name} := raw_{f.name}' for f in c.fields)})) as varchar) as raw_record from {c.dataset}_checked where len(failures) > 0"
    for c in (ORDERS, ITEMS, PAYMENTS)
)


@query(f"with {_ALL_SQL} {_QUARANTINE_SQL}")
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    """All rejected rows with every failed rule, the primary one, and whether they fail only because of their parent."""
    return reduce(DataFrame.unionByName, [contracts.quarantine(o) for o in outcomes(spark, d).values()])


@query(f"""with {_ALL_SQL}, q as ({_QUARANTINE_SQL})
    select source_dataset as dataset, primary_rule, rejection_type, severity, cast(count(*) as bigint) as n_rows, array_to_string(list_sort(list(source_record_id))[1:3], '|') as example_record_ids from q group by 1, 2, 3, 4""")
def quarantine_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rejected rows per primary rule with up to three example ids."""
    q, keys = quarantine(spark, d).withColumnRenamed("source_dataset", "dataset"), ["dataset", "primary_rule", "rejection_type", "severity"]
    w = W.partitionBy(*keys).orderBy("source_record_id", "row_id")
    firsts = q.select(*keys, "source_record_id", F.row_number().over(w).alias("n")).where("n <= 3")  # a group limit: three rows per group and task are shuffled
    examples = firsts.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("source_record_id")), "|").alias("example_record_ids"))
    return q.groupBy(*keys).agg(F.count("*").alias("n_rows")).join(examples, keys)


@query(f"""with {_ALL_SQL} {" union all ".join(f"select '{c.dataset}' as dataset, cast(sum(n_copies) as bigint) as rows_raw, cast(sum(n_copies - 1) as bigint) as rows_duplicates, cast(count(*) filter (len(failures) > 0 and not ({_CASCADE})) as bigint) as rows_direct, cast(count(*) filter (len(failures) > 0 and {_CASCADE}) as bigint) as rows_cascade, cast(count(*) filter (len(failures) = 0) as bigint) as rows_valid from (select * replace (case when {c.key[0]} is null then 1 else n_copies end as n_copies) from {c.dataset}_checked)" for c in (ORDERS, ITEMS, PAYMENTS))}""")
def row_conservation(spark: SparkSession, d: str) -> DataFrame:
    """Rows read = duplicates + rejected + valid, per dataset."""
    return reduce(DataFrame.unionByName, [contracts.conservation(o) for o in outcomes(spark, d).values()])


@query(f"""with {_ALL_SQL},
    long as ({" union all ".join(f"select '{c.dataset}' as dataset, unnest(list_concat(list_transform(failures, lambda f: 'rule/' || f), list_filter([{', '.join(f'''case when coalesce(raw_{f.name}, '') <> coalesce(std_{f.name}, '') then 'standardize/{f.name}' end''' for f in c.fields)}{''', case when total_amount > 2000 then 'soft_rule/business:large_total' end''' if c is ORDERS else ''}], lambda f: f is not null))) as what from {c.dataset}_checked" for c in (ORDERS, ITEMS, PAYMENTS))}),
    sizes as ({" union all ".join(f"select '{c.dataset}' as dataset, count(*) as n from {c.dataset}_checked" for c in (ORDERS, ITEMS, PAYMENTS))}),
    every as (select dataset, split_part(what, '/', 1) as check_type, regexp_extract(what, '/(.*)', 1) as rule_name, count(*) as affected, max(n) as n from long join sizes using (dataset) group by 1, 2, 3
      {"".join(f" union all select '{c.dataset}', 'duplicates', 'business_key', sum(case when {c.key[0]} is null then 0 else n_copies - 1 end), count(*) from {c.dataset}_checked" for c in (ORDERS, ITEMS, PAYMENTS))})
    select dataset, check_type, rule_name, cast(affected as bigint) as rows_affected, cast(n as bigint) as rows_checked, round(affected / n * 100, 3) as affected_pct,
      case check_type when 'rule' then case when starts_with(rule_name, 'parent_rejected') then 'cascade' else 'quarantined' end when 'standardize' then 'fixed' when 'soft_rule' then 'flagged' else 'removed' end as outcome from every""")
def quality_results(spark: SparkSession, d: str) -> DataFrame:
    """Rows affected per rule, soft flag, standardised column and by de-duplication, with what became of them."""
    return reduce(DataFrame.unionByName, [contracts.quality_rows(o) for o in outcomes(spark, d).values()])


@query("""with c as (select lower(nullif(trim(brand, ' '), '')) as v, nullif(trim(brand, ' '), '') as s, count(*) as n from products where nullif(trim(brand, ' '), '') is not null group by 1, 2),
    b as (select v, s from (select *, row_number() over (partition by v order by n desc, s) as r from c) where r = 1)
    select brand_as_received, s as brand, cast(count(*) as bigint) as n from (select brand as brand_as_received, lower(nullif(trim(brand, ' '), '')) as v from products) left join b using (v) group by 1, 2""")
def majority_spelling(spark: SparkSession, d: str) -> DataFrame:
    """Brands as received and as the majority writes them."""
    p = table(spark, d, "products").select(F.col("brand").alias("brand_as_received"), contracts.clean(F.col("brand")).alias("brand"))
    return contracts.majority_spelling(p, "brand").groupBy("brand_as_received", "brand").agg(F.count("*").alias("n"))


@query(f"select row_id, payment_ts as received, {_TS.format('p')} as parsed from (select *, nullif(trim(payment_ts, ' '), '') as p from brz_payments)")
def multi_format_timestamp(spark: SparkSession, d: str) -> DataFrame:
    """Payment times from five layouts; null where none fits."""
    return table(spark, d, "brz_payments").select("row_id", F.col("payment_ts").alias("received"), instant(contracts.clean(F.col("payment_ts"))).cast("timestamp_ntz").alias("parsed"))


_HASHED = ["payment_id", "order_id", "attempt_no", "method", "amount", "status", "payment_ts"]


@query("select row_id, sha256(concat_ws(chr(31), " + ", ".join(f"coalesce({c}, chr(0))" for c in _HASHED) + ")) as record_hash from brz_payments")
def record_hash_sha256(spark: SparkSession, d: str) -> DataFrame:
    """Content hash of every payment row."""
    return table(spark, d, "brz_payments").select("row_id", bronze.record_hash(_HASHED).alias("record_hash"))


_FILE_START = r"try_strptime(regexp_extract(_source_file, '__(\d{4}-\d\d-\d\dT\d\d-\d\d)', 1), '%Y-%m-%dT%H-%M')"


@query(f"select row_id, case when late then 'true' when not late then 'false' end as is_late from (select row_id, {_TS.format('p')} + interval 330 minute < {_FILE_START} as late from (select *, nullif(trim(payment_ts, ' '), '') as p from brz_payments))")
def late_flag(spark: SparkSession, d: str) -> DataFrame:
    """Whether a payment happened before the period its file covers."""
    return table(spark, d, "brz_payments").select("row_id", bronze.late_flag(instant(contracts.clean(F.col("payment_ts"))), F.col("_source_file")).alias("is_late"))


@query(f"""with e as (select row_id, _bronze_batch_id as b, {_TS.format('p')} as ts from (select *, nullif(trim(payment_ts, ' '), '') as p from brz_payments)),
    m as (select b, max(top) over (order by b rows between unbounded preceding and 1 preceding) - interval 2 hour as mark from (select b, max(ts) as top from e group by 1))
    select row_id, case when ts < mark then 'true' when not ts < mark then 'false' end as beyond_watermark from e join m using (b)""")
def watermark_label(spark: SparkSession, d: str) -> DataFrame:
    """Whether a payment lies more than two hours before everything in earlier batches."""
    e = table(spark, d, "brz_payments").select("row_id", F.col("_bronze_batch_id").alias("batch"), instant(contracts.clean(F.col("payment_ts"))).alias("event"))
    return bronze.beyond_watermark(e, "batch", "event").select("row_id", "beyond_watermark")


@query("select event_type, try_cast(json_extract_string(props, '$.k') as int) as k, cast(count(*) as bigint) as n, cast(sum(cast(value as decimal(12,2))) as decimal(18,2)) as total from events group by 1, 2")
def json_extract_events(spark: SparkSession, d: str) -> DataFrame:
    """A JSON field pulled out on the JVM; malformed JSON gives null."""
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).cast("decimal(18,2)").alias("total"))
