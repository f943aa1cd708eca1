"""Items that appear together: how often each pair shares a basket, and how much more often than chance.

Method: items are de-duplicated per basket, ordered pairs emitted, counts combined map-side; lift and pointwise mutual
information come from the marginals. Items too rare (or too common) for any pair to reach the thresholds are dropped
before pairs are emitted, which loses no pair: a pair is never in more baskets than either of its items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: From this support on, the kept items are broadcast: they are at most (mean basket size / BROADCAST_SUPPORT).
BROADCAST_SUPPORT = 1e-4


def item_pairs(df: DataFrame, basket: Column, item: Column, min_both: int = 1, min_support: float = 0.0, min_lift: float = 0.0, block: int = 1024) -> DataFrame:
    """One row per pair item_a < item_b with baskets_both >= min_both, support >= min_support and lift >= min_lift.

    baskets_a, baskets_b, baskets_both, n_baskets; support = both / n; lift = both * n / (a * b); confidence_ab = both / a,
    confidence_ba = both / b; pmi = log2(lift); npmi = pmi / -log2(support). Rows with a null basket or item do not count;
    an item repeated in a basket counts once; a blank key is a key. An empty table gives no pair. Without thresholds
    every pair that shares a basket comes out, however rare.

    The items of a basket are numbered and cut into blocks of `block`: a pair lies in exactly one cell (block of a, block
    of b) of its basket. Cells are what is shuffled and collected, so no array is longer than `block` and the cells of a
    huge basket are spread over tasks. A basket of up to `block` items is one cell.
    """
    held = _held(df, basket, item)
    n = F.broadcast(held.select("basket").distinct().agg(F.count("*").alias("n_baskets")))  # one row
    items = held.groupBy("item").agg(F.count("*").alias("baskets"))
    rows = held
    if min_both > 1 or min_support > 0 or min_lift > 0:
        # The best a pair with this item can reach; the slack covers the rounding of the division.
        share = F.col("baskets") / F.col("n_baskets")
        able = (F.col("baskets") >= min_both) & (share >= min_support) & (1 / share >= min_lift * (1 - 1e-9))
        kept = items.join(n).where(able).select("item", "baskets")
        rows = held.join(F.broadcast(kept) if min_support >= BROADCAST_SUPPORT else kept, "item").select("basket", "item")
    own = W.partitionBy("basket")
    ranked = rows.select("basket", "item", F.row_number().over(own.orderBy("item")).alias("r"), F.count("*").over(own).alias("size")).where("size > 1")
    blocks = ranked.select("basket", "item", F.floor((F.col("r") - 1) / block).cast("int").alias("own"), F.floor((F.col("size") - 1) / block).cast("int").alias("last"))
    other = blocks.select("basket", "item", "own", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    # One struct as the key: by its parts Spark would leave all cells of a basket in the task of the basket.
    cell = F.struct("basket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    parts = other.select(cell.alias("cell"), "item", "own").groupBy("cell").agg(
        F.collect_list(F.when(F.col("own") == F.col("cell.i"), F.col("item"))).alias("low"),
        F.collect_list(F.when(F.col("own") > F.col("cell.i"), F.col("item"))).alias("high"),
    )
    partners = F.when(F.col("cell.i") == F.col("cell.j"), F.col("low")).otherwise(F.col("high"))
    pairs = parts.select(F.explode("low").alias("item_a"), partners.alias("partners")).select("item_a", F.explode("partners").alias("item_b")).where("item_a < item_b")
    counts = pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("baskets_both")).where(F.col("baskets_both") >= min_both).join(n)
    counts = counts.where(F.col("baskets_both") / F.col("n_baskets") >= min_support)
    for side in "ab":
        counts = counts.join(items.select(F.col("item").alias(f"item_{side}"), F.col("baskets").alias(f"baskets_{side}")), f"item_{side}")
    scored = _measures(counts.select("item_a", "item_b", "baskets_a", "baskets_b", "n_baskets", "baskets_both"))
    return _information(scored.where(F.col("lift") >= min_lift))


def _held(df: DataFrame, basket: Column, item: Column) -> DataFrame:
    return df.select(basket.alias("basket"), item.alias("item")).where(F.col("basket").isNotNull() & F.col("item").isNotNull()).distinct()


def _measures(counts: DataFrame) -> DataFrame:
    both = F.col("baskets_both")
    return counts.withColumns({"support": both / F.col("n_baskets"), "lift": (both * F.col("n_baskets")) / (F.col("baskets_a") * F.col("baskets_b"))})


def _information(scored: DataFrame) -> DataFrame:
    both, pmi = F.col("baskets_both"), F.log2("lift")
    return scored.withColumns(
        {
            "confidence_ab": both / F.col("baskets_a"),
            "confidence_ba": both / F.col("baskets_b"),
            "pmi": pmi,
            "npmi": F.when(F.col("support") < 1, pmi / -F.log2("support")).otherwise(F.lit(1.0)),
        }
    )
