from collections import Counter

import pytest

from tidemill.operators import contracts, generate
from tidemill.operators.contracts import Check, Contract, Field, Lookup, Sql
from tidemill.plans.datasets import CONTRACTS, Shop, needs
from tidemill.plans.inventory import ledger


def test_every_dataset_keeps_its_rows(spark, sf):
    shop = Shop(spark, sf)
    for name in ("categories", "stores", "customers", "orders", "order_items", "order_promotions", "deliveries"):
        o = shop.get(name)
        c = contracts.conservation(o).first()
        assert c.rows_raw == shop.raw(name).count() == c.rows_duplicates + c.rows_direct + c.rows_cascade + c.rows_valid and c.rows_valid > 0, name


def test_parents_come_first():
    order = [n for c in CONTRACTS for n in needs(c)]
    assert needs("returns_refunds")[-1] == "returns_refunds" and needs("payments").index("orders") < needs("payments").index("order_totals")
    assert set(CONTRACTS) <= set(order) and len(CONTRACTS) == 19


def test_lookups_soft_flags_and_emails(spark):
    c = Contract(
        "x",
        ("k",),
        (Field("k", style="upper"), Field("email", required=False, style="email"), Field("meta", required=False), Field("n", "int")),
        (Check("business:off", Sql("n <> seen"), hard=False), Check("business:unsure", Sql("n <> seen"), hard=False, unknown_passes=False), Check("malformed:meta", Sql("meta is not null and get_json_object(meta, '$') is null"))),
        lookups=(Lookup("k", "p", "k", {"v": "seen"}),),
    )
    rows = [("1", "a", " A@b.CO ", '{"x": 1}', "1", 1), ("2", "b", "nope", None, "2", 1), ("3", "c", None, "not json", "x", 1), ("4", "d", None, None, "4", 1)]
    raw = spark.createDataFrame(rows, "row_id string, k string, email string, meta string, n string, _ingestion_ts int")
    parent = spark.createDataFrame([("A", 1), ("B", 3), ("B", 5), (None, 9)], "k string, v int")
    o = contracts.check(raw, c, {"p": parent})
    got = {r.k: (r.email, r.dq_email_invalid, r.dq_off, r.dq_unsure) for r in o.valid.collect()}
    assert got == {"A": ("a@b.co", False, False, False), "B": (None, True, True, True), "D": (None, False, False, None)}
    q = contracts.quarantine(o).first()
    assert (q.primary_rule, q.failed_rules, q.raw_record) == ("malformed:meta", "malformed:meta|type_invalid:n", '{"k":"c","email":null,"meta":"not json","n":"x"}')


def test_ledger_by_hand(spark):
    moves = [("s", "p", 1, "sale", -3), ("s", "p", 4, "restock", 10), ("s", "p", 6, "sale", -2), ("s", "q", 1, "sale", -1)]
    counts = [("s", "p", 2, 20, 5), ("s", "p", 5, 28, 5)]
    df = ledger(spark.createDataFrame(moves, "store_id string, product_id string, ts int, kind string, delta int"), spark.createDataFrame(counts, "store_id string, product_id string, ts int, counted int, reorder_level int"))
    got = [(r.ts, r.stock, r.gap) for r in df.sort("ts").collect()]
    assert got == [(1, 20, None), (2, 20, None), (4, 30, None), (5, 28, -2), (6, 26, None)]  # before the first count backwards; 30 reckoned, 28 counted


def test_stock_policy_by_hand(spark):
    demand = [5, 30, 3, 0, 50, 1]
    days = spark.createDataFrame([("a", i, d) for i, d in enumerate(demand)], "k string, day int, units bigint")
    stock, due, sold, lost, orders, empty = 40, [0, 0], 0, 0, 0, 0
    for d in demand:
        stock += due.pop(0)
        s = min(stock, d)
        stock, sold, lost = stock - s, sold + s, lost + d - s
        q = 0
        if stock + due[0] <= 10:
            q, orders = 50 - stock - due[0], orders + 1
        due.append(q)
        empty += stock == 0
    r = generate.simulated_stock(days, ["k"], "day", "units", 40, 10, 50).first()
    assert (r.days, r.sold, r.lost, r.orders, r.empty_days, r.stock) == (6, sold, lost, orders, empty, stock)


@pytest.mark.parametrize("n", [1, 1000])
def test_mutations_and_budget(spark, n):
    assert sum(generate.budget(n, {"a": 0.1, "b": 0.05}, ["a", "b"]).values()) == round(n * 0.15)
    df = spark.range(2000).selectExpr("id", "'abc 10.5' as v")
    kinds = Counter(r.mutation for r in generate.spoiled(df, "id", "v").collect())
    assert set(kinds) == set(generate.MUTATIONS) and sum(kinds.values()) == 2000
