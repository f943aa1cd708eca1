"""The datasets of the shop through their contracts, parents before children, and the orders reconciled with their lines.

Tables that the engine's own data lacks are made of those it has by SQL that any engine runs, faults included; every column
arrives as text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import contracts
from tidemill.operators.contracts import Check, Contract, Field, Lookup, Outcome, Reference, Sql
from tidemill.plans import quality, silver
from tidemill.plans.registry import Registry
from tidemill.scale import written
from tidemill.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

# The allowed words of the datasets.
DELIVERY_STATUS = ("delivered", "cancelled", "failed")
CANCEL_STAGE = ("pre_dispatch", "post_dispatch")
CANCEL_REASON = ("customer_changed_mind", "item_unavailable", "payment_issue", "duplicate_order", "delivery_delayed", "customer_unreachable", "address_issue")
EVENT_TYPE = ("restock", "damage", "adjustment")
AVAILABILITY = ("active", "on_leave", "inactive")
REFUND_REASON = ("order_cancelled", "damaged_item", "missing_item", "quality_issue", "expired_product")
REFUND_STATUS = ("completed", "pending", "rejected")
APP_EVENT = ("click", "view", "purchase", "signup")
LOG_LEVEL = ("INFO", "WARN", "ERROR", "DEBUG")
SERVICE = ("order-service", "payment-service", "inventory-service", "delivery-service", "search-service")
CITIES = tuple(f"C{i:02d}" for i in range(1, 24))
#: An order with a line of so many units is a bulk order.
BULK = 8


def _range(column: str, low: str | None = None, high: str | None = None, open_low: bool = False) -> Check:
    parts = [f"{column} {'<=' if open_low else '<'} {low}"] * (low is not None) + [f"{column} > {high}"] * (high is not None)
    return Check(f"range_invalid:{column}", Sql(" or ".join(parts)))


def _sequence(detail: str, later: str, earlier: str) -> Check:
    return Check(f"sequence_invalid:{detail}", Sql(f"{later} < {earlier}"))


def _day(ts: str) -> Sql:
    """The local (+05:30) date of an instant."""
    return Sql(f"cast({ts} + interval '330' minute as date)")


_id = lambda n: Field(n, style="upper")
_CITY = Field("city_id", style="upper", values=CITIES)

CONTRACTS: dict[str, Contract] = {
    c.dataset: c
    for c in (
        Contract("categories", ("category_id",), (_id("category_id"), Field("category_name", style="title"))),
        Contract("stores", ("store_id",), (_id("store_id"), Field("store_name"), _CITY, Field("city", style="title"), Field("state"), Field("latitude", "double"), Field("longitude", "double")), (_range("latitude", "-90", "90"), _range("longitude", "-180", "180"))),
        Contract("customers", ("customer_id",), (_id("customer_id"), Field("name"), Field("email", required=False, style="email"), _CITY, Field("signup_date", "date"))),
        Contract("weather", ("city_id", "observation_ts"), (_CITY, Field("observation_ts", "timestamp"), *[Field(n, "double") for n in ("temperature_c", "rainfall_mm", "humidity_pct")]), (_range("humidity_pct", "0", "100"), _range("rainfall_mm", "0"), _range("temperature_c", "-20", "60")), derive={"business_date": _day("observation_ts")}),
        Contract("application_logs", ("log_id",), (_id("log_id"), Field("event_ts", "timestamp"), Field("service", style="lower", values=SERVICE), Field("log_level", style="upper", values=LOG_LEVEL), Field("message")), derive={"business_date": _day("event_ts")}),
        Contract("products", ("product_id",), (_id("product_id"), Field("product_name"), _id("category_id"), Field("brand", style="majority"), Field("price", "decimal(12,2)")), (_range("price", "0", "100000", open_low=True),), (Reference("category_id", "categories", "category_id"),)),
        Contract("promotions", ("promotion_id",), (_id("promotion_id"), Field("name"), _id("category_id"), Field("discount_pct", "decimal(12,2)"), Field("start_date", "date"), Field("end_date", "date")), (_range("discount_pct", "0", "100", open_low=True), _sequence("end_before_start", "end_date", "start_date")), (Reference("category_id", "categories", "category_id"),)),
        Contract("delivery_partners", ("partner_id",), (_id("partner_id"), Field("partner_name"), _id("store_id"), _CITY, Field("availability_status", style="lower", values=AVAILABILITY)), (), (Reference("store_id", "stores", "store_id"),)),
        Contract("orders", ("order_id",), silver.ORDERS.fields, (_range("total_amount", "0"),), (Reference("customer_id", "customers", "customer_id"), Reference("store_id", "stores", "store_id")), event="order_ts", derive={"business_date": _day("order_ts")}),
        Contract(
            "order_items",
            ("order_id", "product_id"),
            silver.ITEMS.fields,
            (_range("quantity", "1", "100"), _range("unit_price", "0", open_low=True), Check("business:unit_price_mismatch", Sql("abs(unit_price - catalog_price) > 0.005"), hard=False)),
            (Reference("order_id", "orders", "order_id"), Reference("product_id", "products", "product_id")),
            derive={"line_amount": Sql("cast(quantity * unit_price as decimal(12,2))")},
            lookups=(Lookup("product_id", "products", "product_id", {"price": "catalog_price"}),),
        ),
        Contract(
            "order_promotions",
            ("order_id", "promotion_id"),
            (_id("order_id"), _id("promotion_id"), Field("discount_amount", "decimal(12,2)")),
            (_range("discount_amount", "0", open_low=True), Check("business:promo_inactive", Sql("order_date < promo_start or order_date > promo_end"), hard=False)),
            (Reference("order_id", "orders", "order_id"), Reference("promotion_id", "promotions", "promotion_id")),
            lookups=(Lookup("order_id", "orders", "order_id", {"business_date": "order_date"}), Lookup("promotion_id", "promotions", "promotion_id", {"start_date": "promo_start", "end_date": "promo_end"})),
        ),
        Contract(
            "payments",
            ("payment_id",),
            silver.PAYMENTS.fields,
            (
                _range("amount", "0"),
                _range("attempt_no", "1", "5"),
                Check("business:amount_mismatch", Sql("abs(amount - order_total) > 0.005 and coalesce(abs(amount - computed_total) > 0.005, true)"), hard=False),
            ),
            (Reference("order_id", "orders", "order_id"),),
            event="payment_ts",
            derive={"business_date": _day("payment_ts")},
            lookups=(Lookup("order_id", "order_totals", "order_id", {"computed_total": "computed_total"}), Lookup("order_id", "orders", "order_id", {"total_amount": "order_total"})),
        ),
        Contract(
            "deliveries",
            ("delivery_id",),
            (_id("delivery_id"), _id("order_id"), _id("partner_id"), Field("pickup_ts", "timestamp"), Field("delivered_ts", "timestamp", required=False), Field("status", style="lower", values=DELIVERY_STATUS)),
            (
                Check("required_missing:delivered_ts", Sql("status = 'delivered' and std_delivered_ts is null")),
                _sequence("delivered_before_pickup", "delivered_ts", "pickup_ts"),
                Check("business:partner_wrong_city", Sql("partner_city <> store_city"), hard=False),
            ),
            (Reference("order_id", "orders", "order_id"), Reference("partner_id", "delivery_partners", "partner_id")),
            derive={
                "business_date": _day("pickup_ts"),
                "delivery_minutes": Sql("case when status = 'delivered' then round((unix_timestamp(delivered_ts) - unix_timestamp(pickup_ts)) / 60, 1) end", "case when status = 'delivered' then round(date_diff('second', pickup_ts, delivered_ts) / 60, 1) end"),
            },
            lookups=(Lookup("partner_id", "delivery_partners", "partner_id", {"city_id": "partner_city"}), Lookup("order_id", "order_cities", "order_id", {"city_id": "store_city"})),
        ),
        Contract(
            "cancellations",
            ("cancellation_id",),
            (_id("cancellation_id"), _id("order_id"), Field("stage", style="lower", values=CANCEL_STAGE), Field("reason", style="lower", values=CANCEL_REASON), Field("cancelled_ts", "timestamp")),
            (_sequence("cancelled_before_order", "cancelled_ts", "ordered_ts"),),
            (Reference("order_id", "orders", "order_id"),),
            derive={"business_date": _day("cancelled_ts")},
            lookups=(Lookup("order_id", "orders", "order_id", {"order_ts": "ordered_ts"}),),
        ),
        Contract(
            "inventory_snapshots",
            ("store_id", "product_id", "snapshot_ts"),
            (_id("snapshot_id"), _id("store_id"), _id("product_id"), Field("stock_quantity", "int"), Field("reorder_level", "int"), Field("snapshot_ts", "timestamp")),
            (_range("stock_quantity", "0"), _range("reorder_level", "0")),
            (Reference("store_id", "stores", "store_id"), Reference("product_id", "products", "product_id")),
            derive={"business_date": _day("snapshot_ts")},
        ),
        Contract(
            "inventory_events",
            ("event_id",),
            (_id("event_id"), _id("store_id"), _id("product_id"), Field("event_type", style="lower", values=EVENT_TYPE), Field("quantity", "int"), Field("event_ts", "timestamp")),
            (Check("range_invalid:quantity", Sql("(event_type = 'restock' and quantity <= 0) or (event_type = 'damage' and quantity >= 0) or (event_type = 'adjustment' and quantity = 0)")),),
            (Reference("store_id", "stores", "store_id"), Reference("product_id", "products", "product_id")),
            derive={"business_date": _day("event_ts")},
        ),
        Contract(
            "reviews",
            ("review_id",),
            (_id("review_id"), _id("customer_id"), _id("product_id"), _id("order_id"), Field("rating", "int"), Field("comment", required=False), Field("review_ts", "timestamp")),
            (_range("rating", "1", "5"), Check("business:unverified_purchase", Sql("case when incomplete is null then purchased is null end"), hard=False, unknown_passes=False)),
            (Reference("customer_id", "customers", "customer_id"), Reference("product_id", "products", "product_id"), Reference("order_id", "orders", "order_id")),
            derive={"business_date": _day("review_ts")},
            lookups=(Lookup("concat(order_id, '|', product_id)", "purchases", "purchase", {"one": "purchased"}), Lookup("order_id", "incomplete_orders", "order_id", {"one": "incomplete"})),
        ),
        Contract(
            "application_events",
            ("event_id",),
            (_id("event_id"), Field("customer_id", required=False, style="upper"), _id("session_id"), Field("event_name", style="lower", values=APP_EVENT), Field("event_ts", "timestamp"), Field("metadata")),
            (Check("malformed:metadata", Sql("metadata is not null and get_json_object(metadata, '$') is null", "metadata is not null and not json_valid(metadata)")),),
            (Reference("customer_id", "customers", "customer_id"),),
            derive={"business_date": _day("event_ts"), "platform": Sql("get_json_object(metadata, '$.platform')", "json_extract_string(metadata, '$.platform')"), "app_version": Sql("get_json_object(metadata, '$.app_version')", "json_extract_string(metadata, '$.app_version')")},
        ),
        Contract(
            "returns_refunds",
            ("refund_id",),
            (_id("refund_id"), _id("payment_id"), _id("order_id"), Field("amount", "decimal(12,2)"), Field("reason", style="lower", values=REFUND_REASON), Field("status", style="lower", values=REFUND_STATUS), Field("refund_ts", "timestamp")),
            (_range("amount", "0", open_low=True), Check("business:refund_exceeds_payment", Sql("amount > payment_amount + 0.005")), _sequence("refund_before_payment", "refund_ts", "paid_ts")),
            (Reference("payment_id", "payments", "payment_id"), Reference("order_id", "orders", "order_id")),
            derive={"business_date": _day("refund_ts")},
            lookups=(Lookup("payment_id", "payments", "payment_id", {"amount": "payment_amount", "payment_ts": "paid_ts"}),),
        ),
    )
}

_TEXT = "replace(cast(date_trunc('second', {}) as string), ' ', 'T') || 'Z'"
_md5 = lambda *cs: "md5(" + " || '|' || ".join(f"coalesce(cast({c} as string), '~')" for c in cs) + ")"
_pick = lambda words, by: f"case {by} % {len(words)} " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(words)) + " end"

#: The datasets as they arrive, in SQL that both engines run.
RAW: dict[str, str] = {
    "categories": f"""select {_md5('category_id')} as row_id, case when category_id like '%3' then ' ' || lower(category_id) || ' ' else category_id end as category_id, case when category_id like '%7' then null else 'FRESH goods ' || category_id end as category_name, max(_ingestion_ts) as _ingestion_ts
      from products where category_id is not null group by category_id""",
    "stores": f"select {_md5('store_id', 'store_name', 'city_id', 'city', 'state', 'latitude', 'longitude', '_ingestion_ts')} as row_id, store_id, store_name, city_id, city, state, latitude, case when store_id like '%9' then 200.5 else longitude end as longitude, _ingestion_ts from stores",
    "customers": """select min(row_id) as row_id, c as customer_id, case when min(row_id) % 31 = 0 then ' ' else ' Customer ' || c end as name, case when min(row_id) % 7 = 0 then 'no address' when min(row_id) % 7 = 1 then null else ' ' || c || '@Example.COM' end as email,
      case when min(row_id) % 29 = 0 then 'X99' else 'c0' || cast(min(row_id) % 9 + 1 as string) end as city_id, case when min(row_id) % 23 = 0 then '2025-02-30' else '2024-0' || cast(min(row_id) % 9 + 1 as string) || '-1' || cast(min(row_id) % 10 as string) end as signup_date, min(_ingestion_ts) as _ingestion_ts
      from (select row_id, upper(trim(customer_id)) as c, _ingestion_ts from slv_orders where customer_id is not null) x group by c""",
    "weather": f"""select {_md5('city_id', 'business_date')} as row_id, city_id, cast(business_date as string) || 'T06:00:00Z' as observation_ts, cast(max(units) % 70 - 5 as string) as temperature_c, case when max(units) % 11 = 0 then '-1.5' when max(units) % 11 = 1 then 'wet' else cast(max(units) % 20 as string) || '.5' end as rainfall_mm,
      cast(max(units) % 104 as string) as humidity_pct, max(published_at) as _ingestion_ts from gld_daily_sales group by city_id, business_date""",
    "products": f"select {_md5('product_id', 'product_name', 'category_id', 'brand', 'price', '_ingestion_ts', '_deleted_at')} as row_id, product_id, product_name, category_id, brand, case when product_id like '%77' then '0' else cast(price as string) end as price, _ingestion_ts from products",
    "promotions": f"""select {_md5('category_id')} as row_id, 'PR' || upper(trim(category_id)) as promotion_id, 'Offer ' || category_id as name, case when category_id like '%5' then 'CAT99' else category_id end as category_id, case when category_id like '%8' then '150' else '12.5' end as discount_pct, '2025-04-05' as start_date,
      case when category_id like '%2' then '2025-03-01' else '2025-06-15' end as end_date, max(_ingestion_ts) as _ingestion_ts from products where category_id is not null group by category_id""",
    "delivery_partners": f"""select {_md5('store_id', 'k.n')} as row_id, 'DP' || upper(trim(store_id)) || '-' || cast(k.n as string) as partner_id, 'Rider ' || store_id as partner_name, case when k.n = 3 and store_id like '%1' then 'S999999' else store_id end as store_id, max(city_id) as city_id,
      case when k.n = 1 then 'Active ' when k.n = 2 then 'on_leave' else case when store_id like '%4' then 'asleep' else 'inactive' end end as availability_status, max(_ingestion_ts) as _ingestion_ts from stores cross join (values (1), (2), (3)) k(n) where store_id is not null group by store_id, k.n""",
    "orders": f"select row_id, order_id, customer_id, store_id, {_TEXT.format('order_ts')} as order_ts, status, total_amount, _ingestion_ts from slv_orders",
    "order_items": "select row_id, order_item_id, order_id, product_id, quantity, unit_price, _ingestion_ts from slv_order_items",
    "order_promotions": "select row_id, order_id, 'PRCAT' || lpad(cast(row_id % 26 as string), 2, '0') as promotion_id, case when row_id % 40 = 0 then '-1' when row_id % 40 = 4 then 'ten' else cast(row_id % 50 + 1 as string) || '.25' end as discount_amount, _ingestion_ts from slv_orders where row_id % 4 = 0",
    "payments": "select row_id, payment_id, order_id, attempt_no, method, amount, status, payment_ts, _ingestion_ts from brz_payments",
    "deliveries": f"""select row_id, 'DL' || cast(row_id as string) as delivery_id, order_id, 'DP' || upper(trim(store_id)) || '-' || cast(row_id % 2 + 1 as string) as partner_id, {_TEXT.format("order_ts + interval '10' minute")} as pickup_ts,
      case when row_id % 19 = 0 then null when row_id % 19 = 1 then {_TEXT.format("order_ts")} else {_TEXT.format("order_ts + interval '23' minute")} end as delivered_ts, case when row_id % 17 = 0 then 'LOST' when row_id % 17 = 1 then 'Failed' else 'delivered' end as status, _ingestion_ts from slv_orders where row_id % 3 <> 0""",
    "cancellations": f"""select row_id, 'CN' || cast(row_id as string) as cancellation_id, order_id, {_pick(CANCEL_STAGE, 'row_id')} as stage, {_pick((*CANCEL_REASON, 'No Reason'), 'row_id')} as reason, case when row_id % 9 = 0 then {_TEXT.format("order_ts - interval '5' minute")} else {_TEXT.format("order_ts + interval '5' minute")} end as cancelled_ts, _ingestion_ts
      from slv_orders where lower(trim(status)) = 'cancelled'""",
    "inventory_snapshots": f"""select {_md5('store_id', 'business_date', 'units', 'published_at', 'net_revenue', 'gmv')} as row_id, 'SN-' || store_id || '-' || cast(business_date as string) as snapshot_id, store_id, 'P' || lpad(cast(units % 520 as string), 4, '0') as product_id, cast(units - 20 as string) as stock_quantity, case when units % 13 = 0 then '1.5' else '25' end as reorder_level,
      replace(cast(business_date as string), '-', '/') || ' 04:00:00' as snapshot_ts, published_at as _ingestion_ts from gld_daily_sales""",
    "reviews": f"""select i.row_id, 'RV' || cast(i.row_id as string) as review_id, o.customer_id, case when i.row_id % 15 = 0 then 'P0001' else i.product_id end as product_id, i.order_id, cast(i.row_id % 7 as string) as rating, case when i.row_id % 2 = 0 then ' fine ' end as comment, {_TEXT.format('i._ingestion_ts')} as review_ts, i._ingestion_ts
      from slv_order_items i left join (select upper(trim(order_id)) as k, min(customer_id) as customer_id from slv_orders group by 1) o on o.k = upper(trim(i.order_id)) where i.row_id % 3 = 0""",
    "application_events": f"""select event_id as row_id, 'AE' || cast(event_id as string) as event_id, case when event_id % 5 = 0 then null else 'CUST' || lpad(cast(user_id as string), 8, '0') end as customer_id, 'SES' || cast(user_id as string) as session_id, event_type as event_name, {_TEXT.format('ts')} as event_ts,
      case when event_id % 37 = 0 then 'not json' when event_id % 37 = 1 then ' ' else '{{"platform": "ios", "app_version": "' || cast(event_id % 4 as string) || '.1"}}' end as metadata, ts as _ingestion_ts from events""",
    "returns_refunds": f"""select row_id, 'RF' || cast(row_id as string) as refund_id, payment_id, order_id, case when row_id % 10 = 0 then amount || '0' when row_id % 10 = 5 then '0' else '9.50' end as amount, {_pick((*REFUND_REASON, 'bored'), 'row_id')} as reason, {_pick(REFUND_STATUS, 'row_id')} as status,
      case when row_id % 14 = 0 then '2025-01-01T00:00:00Z' else {_TEXT.format("_ingestion_ts + interval '2' hour")} end as refund_ts, _ingestion_ts from brz_payments where row_id % 5 = 0""",
}
#: Datasets that come from landing rows: the query that loads them strictly, and its columns.
LANDED: dict[str, str] = {"application_logs": "p3_application_logs", "inventory_events": "p3_inventory_events"}
_TABLES = ("products", "stores", "slv_orders", "slv_order_items", "brz_payments", "gld_daily_sales", "events")

# Tables made of outcomes, which some contracts look things up in: (datasets needed, SQL over their _checked and _valid).
_TOTALS = (
    ("orders", "order_items", "order_promotions", "products"),
    """select o.order_id, cast(case when b.order_id is null and g.gross is not null then round(g.gross - coalesce(d.discount, 0), 2) end as decimal(12,2)) as computed_total from orders_valid o
      left join (select i.order_id, sum(round(i.quantity * p.price, 2)) as gross from order_items_valid i join products_valid p on p.product_id = i.product_id group by i.order_id) g on g.order_id = o.order_id
      left join (select order_id, sum(discount_amount) as discount from order_promotions_valid group by order_id) d on d.order_id = o.order_id
      left join (select distinct std_order_id as order_id from (select std_order_id, failures from order_items_checked union all select std_order_id, failures from order_promotions_checked) x where {failed} and std_order_id is not null) b on b.order_id = o.order_id""",
)
DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    "order_totals": _TOTALS,
    "order_cities": (("orders", "stores"), "select o.order_id, s.city_id from orders_valid o join stores_valid s on s.store_id = o.store_id"),
    "purchases": (("order_items",), "select order_id || '|' || product_id as purchase, 1 as one from order_items_checked where order_id is not null and product_id is not null group by 1"),
    "incomplete_orders": (("order_items",), "select std_order_id as order_id, 1 as one from order_items_checked where {failed} and std_order_id is not null group by 1"),
}


def needs(name: str) -> list[str]:
    """Everything a dataset or derived table rests on, itself last, in an order in which it can be built."""
    direct = DERIVED[name][0] if name in DERIVED else [r.parent for r in CONTRACTS[name].references] + [x.parent for x in CONTRACTS[name].lookups]
    return list(dict.fromkeys([n for p in direct for n in needs(p)] + [name]))


class Shop:
    """The outcomes of the datasets over one folder of tables, each built when first asked for and written once."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.built = spark, root, {}
        for name in _TABLES:
            table(spark, root, name).createOrReplaceTempView(name)

    def raw(self, name: str) -> DataFrame:
        if name in LANDED:
            loaded = quality.QUERIES[LANDED[name]](self.spark, self.root)
            return loaded.withColumns({"row_id": F.col("line_id"), "_ingestion_ts": F.col("event_ts"), "event_ts": F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss")})
        return self.spark.sql(RAW[name])

    def get(self, name: str) -> Outcome | DataFrame:
        if name not in self.built:
            if name in DERIVED:
                for n in DERIVED[name][0]:
                    o = self.get(n)
                    o.checked.createOrReplaceTempView(f"{n}_checked")
                    o.valid.createOrReplaceTempView(f"{n}_valid")
                self.built[name] = written(self.spark.sql(DERIVED[name][1].format(failed="size(failures) > 0")), name)
            else:
                c = CONTRACTS[name]
                parents = {p: self.get(p) for p in needs(name)[:-1]}
                self.built[name] = contracts.settled(contracts.check(self.raw(name), c, parents), name)
        return self.built[name]


# --- the same in SQL ------------------------------------------------------------------------------------------------

_TITLE = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_STYLE = {"upper": "upper({0})", "lower": "lower({0})", "title": _TITLE, "email": "case when regexp_full_match(lower({0}), '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}') then lower({0}) end"}


def _sql_type(f: Field) -> str:
    std = f"std_{f.name}"
    if f.type == "timestamp":
        return silver._TS.format(std)
    if f.type == "int":
        return f"try_cast(case when regexp_full_match({std}, '[+-]?\\d+') then {std} end as int)"
    return std if f.type == "string" else f"try_cast({std} as {f.type})"


def _other(c: Callable) -> str:
    return c.other or c.text


def contract_sql(name: str) -> str:
    """The CTEs {name}_checked and {name}_valid, or {name} itself for a derived table, given those it needs."""
    if name in DERIVED:
        return f"{name} as materialized ({DERIVED[name][1].format(failed='len(failures) > 0')})"
    c, source = CONTRACTS[name], RAW.get(name)
    if source is None:
        source = f"select line_id as row_id, * exclude (line_id, event_ts), strftime(event_ts, '%Y-%m-%d %H:%M:%S') as event_ts, event_ts as _ingestion_ts from ({quality.SQL[LANDED[name]]})"
    clean = lambda f: f"nullif(trim(cast({f.name} as varchar), ' '), '')"
    std = [f"{_STYLE.get(f.style or '', '{0}').format(clean(f))} as std_{f.name}" for f in c.fields]
    out = [f"{name}_std as (select row_id, _ingestion_ts, {', '.join(f'cast({f.name} as varchar) as raw_{f.name}' for f in c.fields)}, {', '.join(std)} from ({source}) r)"]
    last = f"{name}_std"
    for f in c.fields:
        if f.style == "majority":
            out.append(f"{name}_common as (select v, s from (select lower(std_{f.name}) as v, std_{f.name} as s, row_number() over (partition by lower(std_{f.name}) order by count(*) desc, std_{f.name}) as n from {last} where std_{f.name} is not null group by 1, 2) where n = 1)")
            out.append(f"{name}_spelled as (select x.* replace (coalesce(s, std_{f.name}) as std_{f.name}) from {last} x left join {name}_common on v = lower(std_{f.name}))")
            last = f"{name}_spelled"
    out.append(f"{name}_typed as (select *, {', '.join(f'{_sql_type(f)} as {f.name}' for f in c.fields)} from {last})")
    order = ", ".join(f"{x} desc nulls last" for x in ("_ingestion_ts", c.event, "row_id") if x)
    whole = " and ".join(f"{k} is not null" for k in c.key)
    out.append(f"{name}_last as (select *, row_number() over (partition by {', '.join(c.key)} order by {order}) as n, count(*) over (partition by {', '.join(c.key)}) as copies from {name}_typed)")
    checks = []
    for f in c.fields:
        checks += [(f"required_missing:{f.name}", f"std_{f.name} is null")] * f.required
        checks += [(f"type_invalid:{f.name}", f"std_{f.name} is not null and {f.name} is null")] * (f.type != "string")
        checks += [(f"enum_invalid:{f.name}", f"{f.name} not in {f.values}")] * bool(f.values)
    checks += [(k.name, _other(k.fails)) for k in c.checks if k.hard]
    joins, columns = "", ""
    for i, x in enumerate(c.lookups):
        source = x.parent if x.parent in DERIVED else f"{x.parent}_valid"
        joins += f" left join (select {x.parent_column} as lk{i}, {', '.join(f'min({v}) as {n}' for v, n in x.values.items())} from {source} group by 1) l{i} on l{i}.lk{i} = {x.column if '(' in x.column else 'x.' + x.column}"
        columns += "".join(f", l{i}.{n}" for n in x.values.values())
    looked = f"{name}_looked as (select x.*{columns} from (select *, case when {whole} then copies else 1 end as n_copies from {name}_last where not ({whole}) or n = 1) x{joins})"
    out.append(looked)
    joins = ""
    for i, r in enumerate(c.references):
        joins += f" left join (select std_{r.parent_column} as k, bool_or(len(failures) = 0) as ok from {r.parent}_checked where std_{r.parent_column} is not null group by 1) p{i} on p{i}.k = x.{r.column}"
        checks += [(f"fk_missing:{r.column}", f"x.{r.column} is not null and p{i}.ok is null"), (f"parent_rejected:{r.parent}", f"x.{r.column} is not null and not p{i}.ok")]
    checks.sort(key=lambda k: contracts.PRIORITY.index(k[0].split(":")[0]))
    array = ", ".join(f"case when {e} then '{n}' end" for n, e in checks)
    soft = "".join(f", {_other(k.fails) if not k.unknown_passes else f'coalesce({_other(k.fails)}, false)'} as dq_{k.name.split(':')[1]}" for k in c.checks if not k.hard)
    soft += "".join(f", nullif(trim(raw_{f.name}, ' '), '') is not null and std_{f.name} is null as dq_{f.name}_invalid" for f in c.fields if f.style == "email")
    out.append(f"{name}_checked as materialized (select x.*{soft}, list_filter([{array}], lambda f: f is not null) as failures from {name}_looked x{joins})")
    derived = "".join(f", {_other(e)} as {n}" for n, e in c.derive.items())
    flags = "".join(f", dq_{k.name.split(':')[1]}" for k in c.checks if not k.hard) + "".join(f", dq_{f.name}_invalid" for f in c.fields if f.style == "email")
    out.append(f"{name}_valid as (select row_id, {', '.join(f.name for f in c.fields)}{derived}{flags} from {name}_checked where len(failures) = 0)")
    return ",\n".join(out)


def chain_sql(*names: str) -> str:
    return "with " + ",\n".join(contract_sql(n) for n in dict.fromkeys(x for n in names for x in needs(n)))


_CASCADE = "len(list_filter(failures, lambda f: not starts_with(f, 'parent_rejected'))) = 0"


def _valid(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, d: str) -> DataFrame:
        rows = Shop(spark, d).get(name).valid
        return rows.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in CONTRACTS[name].fields if f.type == "timestamp"})

    build.__doc__ = f"The valid rows of {name}: typed, one per key, with soft flags and derived columns."
    return build


def _rejected(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, d: str) -> DataFrame:
        return contracts.quarantine(Shop(spark, d).get(name))

    build.__doc__ = f"The rejected rows of {name} with all failed rules."
    return build


for _n, _c in CONTRACTS.items():
    QUERIES[f"contract_{_n}"], SQL[f"contract_{_n}"] = _valid(_n), f"{chain_sql(_n)} select * from {_n}_valid"
    _record = " || ';' || ".join(f"'{k}=' || coalesce(std_{k}, '')" for k in _c.key)
    QUERIES[f"rejected_{_n}"] = _rejected(_n)
    SQL[f"rejected_{_n}"] = (
        f"{chain_sql(_n)} select '{_n}' as source_dataset, row_id, {_record} as source_record_id, array_to_string(failures, '|') as failed_rules, failures[1] as primary_rule, case when {_CASCADE} then 'warning' else 'error' end as severity, case when {_CASCADE} then 'cascade' else 'direct' end as rejection_type, cast(to_json(struct_pack({', '.join(f'{f.name} := raw_{f.name}' for f in _c.fields)})) as varchar) as raw_record from {_n}_checked where len(failures) > 0"
    )

_FINAL_SQL = f"""select o.order_id, o.status, o.total_amount, t.computed_total as computed_total_amount, abs(o.total_amount - t.computed_total) > 0.005 as dq_total_mismatch, coalesce(q.most >= {BULK}, false) as is_outlier, o.status = 'delivered' and p.order_id is not null and c.order_id is null as is_completed from orders_valid o
    left join order_totals t on t.order_id = o.order_id left join (select order_id, max(quantity) as most from order_items_valid group by 1) q on q.order_id = o.order_id
    left join (select distinct order_id from payments_valid where status = 'success') p on p.order_id = o.order_id left join (select distinct order_id from cancellations_valid) c on c.order_id = o.order_id"""


@query(f"{chain_sql('order_totals')} select * from order_totals")
def order_total_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Each valid order's total recomputed from its lines at catalogue prices less discounts; null if any of its lines or promotions was rejected."""
    return Shop(spark, d).get("order_totals")


@query(f"{chain_sql('orders', 'order_totals', 'payments', 'cancellations')} {_FINAL_SQL}")
def order_finalisation(spark: SparkSession, d: str) -> DataFrame:
    """Valid orders with their recomputed total, whether it differs, bulk lines, and whether they were delivered, paid and not cancelled."""
    shop = Shop(spark, d)
    orders, totals, items, payments, cancellations = (shop.get(n) for n in ("orders", "order_totals", "order_items", "payments", "cancellations"))
    most = items.valid.groupBy("order_id").agg(F.max("quantity").alias("most"))
    paid = payments.valid.where("status = 'success'").select("order_id").distinct().withColumn("paid", F.lit(True))
    cancelled = cancellations.valid.select("order_id").distinct().withColumn("cancelled", F.lit(True))
    x = orders.valid.select("order_id", "status", "total_amount")
    for other in (totals.withColumnRenamed("computed_total", "computed_total_amount"), most, paid, cancelled):
        x = x.join(other, "order_id", "left")
    return x.select(
        "order_id",
        "status",
        "total_amount",
        "computed_total_amount",
        (F.abs(F.col("total_amount") - F.col("computed_total_amount")) > 0.005).alias("dq_total_mismatch"),
        F.coalesce(F.col("most") >= BULK, F.lit(False)).alias("is_outlier"),
        ((F.col("status") == "delivered") & F.col("paid").isNotNull() & F.col("cancelled").isNull()).alias("is_completed"),
    )


@query(
    chain_sql(*CONTRACTS)
    + " union all ".join(
        f" select '{n}' as dataset, cast(coalesce(sum(n_copies), 0) as bigint) as rows_raw, cast(coalesce(sum(n_copies - 1), 0) as bigint) as rows_duplicates, cast(count(*) filter (len(failures) > 0 and not ({_CASCADE})) as bigint) as rows_direct, cast(count(*) filter (len(failures) > 0 and {_CASCADE}) as bigint) as rows_cascade, cast(count(*) filter (len(failures) = 0) as bigint) as rows_valid from {n}_checked"
        for n in CONTRACTS
    )
)
def shop_conservation(spark: SparkSession, d: str) -> DataFrame:
    """Rows read = duplicates + rejected + valid, for all nineteen datasets."""
    shop = Shop(spark, d)
    return reduce(DataFrame.unionByName, [contracts.conservation(shop.get(n)) for n in CONTRACTS])
