import math
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidemill.functions.keys import norm_key
from tidemill.llm.pairs import item_pairs

SCHEMA = "o string, p string, basket string, item string, n int"


def expected(rows):
    held = {}
    for o, p, *_ in rows:
        if o is not None and p is not None:
            held.setdefault(o.strip().upper(), set()).add(p.strip().upper())
    single, both = Counter(), Counter()
    for items in held.values():
        single.update(items)
        both.update(combinations(sorted(items), 2))
    return len(held), single, both


def test_against_brute_force(spark):
    rows = [(f"o{i % 40}", f"p{(i * i + i // 7) % 9}", "x", "y", 1) for i in range(300)] + [("o1", "p1", "x", "y", 1)] * 5
    rows += [(" O1", "P1 ", None, None, None), (None, "p1", "x", "y", 1), ("o1", None, "x", "y", 1), ("", "p1", "x", "y", 1)] + [("big", f"p{i}", "x", "y", 1) for i in range(200)]
    n, single, both = expected(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.item_a, r.item_b): r for r in item_pairs(df, norm_key(F.col("o")), norm_key(F.col("p")), 1, 1e-9).collect()}
    assert {k: r.baskets_both for k, r in got.items()} == both
    for (a, b), r in got.items():
        lift = both[a, b] * n / (single[a] * single[b])
        assert (r.n_baskets, r.baskets_a, r.baskets_b) == (n, single[a], single[b])
        assert math.isclose(r.lift, lift) and math.isclose(r.pmi, math.log2(lift), abs_tol=1e-12) and math.isclose(r.confidence_ab, both[a, b] / single[a])


def test_thresholds_lose_no_pair(spark):
    rows = [(f"o{i % 97}", f"p{(i * 31 + i * i // 5) % 23}", "x", "y", 1) for i in range(900)]
    n, single, both = expected(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for least, support, lift in ((8, 0.002, 1.0), (2, 0.05, 1.2), (1, 0.1, 0.5)):
        want = {(a, b) for (a, b), k in both.items() if k >= least and k / n >= support and k * n / (single[a] * single[b]) >= lift}
        assert {(r.item_a, r.item_b) for r in item_pairs(df, norm_key(F.col("o")), norm_key(F.col("p")), least, support, lift).collect()} == want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert item_pairs(df, F.col("o"), F.col("p"), 1, 0.1).count() == 0
    assert item_pairs(df, F.col("o"), F.col("p")).count() == 0


def test_a_huge_basket_is_spread(spark):
    """One basket of 700 items in cells of 50: every pair once, with thresholds and without."""
    df = spark.createDataFrame([("big", f"p{i:04d}", None, None, None) for i in range(700)] + [(f"o{i}", "p0000", None, None, None) for i in range(5)], SCHEMA)
    assert item_pairs(df, F.col("o"), F.col("p"), block=50).count() == item_pairs(df, F.col("o"), F.col("p"), 1, 0.1, block=50).count() == 700 * 699 // 2


@pytest.mark.parametrize("block", [1, 3, 16, 1024])
def test_all_pairs_have_no_floor(spark, block):
    # 5,000 baskets of one item put every pair far below any support that item_pairs is asked for.
    rows = [(f"o{i % 40}", f"p{(i * i + i // 7) % 9}", "x", "y", 1) for i in range(300)] + [(f"s{i}", "p1", "x", "y", 1) for i in range(5000)]
    rows += [(" O1", "P1 ", None, None, None), (None, "p1", "x", "y", 1), ("o1", None, "x", "y", 1), ("", "p1", "x", "y", 1)] + [("big", f"p{i}", "x", "y", 1) for i in range(50)]
    n, single, both = expected(rows)
    got = item_pairs(spark.createDataFrame(rows, SCHEMA), norm_key(F.col("o")), norm_key(F.col("p")), block=block).collect()
    assert len(got) == len(both) and {(r.item_a, r.item_b): r.baskets_both for r in got} == both
    for r in got:
        lift = both[r.item_a, r.item_b] * n / (single[r.item_a] * single[r.item_b])
        assert (r.n_baskets, r.baskets_a, r.baskets_b) == (n, single[r.item_a], single[r.item_b]) and math.isclose(r.lift, lift) and math.isclose(r.support, r.baskets_both / n)
    assert any(r.baskets_both == 1 for r in got) and any(r.lift < 1 for r in got)


def test_all_pairs_of_the_tables(spark, sf):
    from tidemill.llm import queries
    from tidemill.sources.tables import table

    rows = table(spark, sf, "slv_order_items").select("order_id", "product_id").collect()
    n, _, both = expected(rows)
    got = queries.QUERIES["p6_all_pairs"](spark, sf).collect()
    assert {(r.product_a, r.product_b): (r.baskets_both, r.n_baskets) for r in got} == {k: (v, n) for k, v in both.items()}
