"""Hybrid recommendations: own repeats, co-purchase and popularity, ranked per customer; and how good a ranking is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.scale import written


def signals(lines: DataFrame, partners: int = 30, co: int = 50, popular: int = 30) -> DataFrame:
    """(customer, product, repeat, copurchase, popular) for every candidate of every customer.

    lines: (order, customer, product). repeat = orders of the product / the customer's most; copurchase = sum over
    products bought of shared orders / sqrt(partner's orders), scaled per customer, the best `co`; popular = orders /
    most orders, the best `popular`. Candidates are the union.

    Own and reached products meet in one aggregation by customer and product; from there each customer is one array
    (its own products, `co` and `popular`), to which the popular ones come from a single broadcast row.
    """
    held = written(lines.select("order", "customer", "product").distinct(), "held")  # read by five branches
    orders = held.groupBy("product").agg(F.count_distinct("order").alias("n"))
    own = held.groupBy("customer", "product").agg(F.count("*").alias("k"))
    a, b = held.select("order", "product"), held.select("order", F.col("product").alias("partner"))
    both = a.join(b, "order").where("product <> partner").groupBy("product", "partner").agg(F.count("*").alias("c"))
    strength = both.join(orders.withColumnRenamed("product", "partner"), "partner").select("product", "partner", (F.col("c") / F.sqrt("n")).alias("s"))
    best = strength.withColumn("r", F.row_number().over(W.partitionBy("product").orderBy(F.desc("s"), "partner"))).where(F.col("r") <= partners)
    reached = own.select("customer", "product").join(best, "product").select("customer", F.col("partner").alias("product"), F.lit(None).cast("bigint").alias("k"), "s")
    each = own.withColumn("s", F.lit(None).cast("double")).unionByName(reached).groupBy("customer", "product").agg(F.max("k").alias("k"), F.round(F.sum("s"), 9).alias("s"))
    w = W.partitionBy("customer")
    place = F.row_number().over(w.orderBy(F.desc_nulls_last("s"), "product"))
    near = F.when(F.col("s").isNotNull() & (place <= co), F.col("s") / F.max("s").over(w))
    scaled = each.select("customer", "product", (F.col("k") / F.max("k").over(w)).alias("repeat"), near.alias("near")).where("repeat is not null or near is not null")
    listed = scaled.groupBy("customer").agg(F.collect_list(F.struct("product", "repeat", "near")).alias("mine"))
    top = orders.orderBy(F.desc("n"), "product").limit(popular).agg(F.collect_list("product").alias("top"))
    added = F.transform(F.array_except("top", F.transform("mine", lambda x: x["product"])), lambda x: F.struct(x.alias("product"), F.lit(None).cast("double").alias("repeat"), F.lit(None).cast("double").alias("near")))
    full = listed.join(F.broadcast(top)).select("customer", F.explode(F.concat("mine", added)).alias("c")).select("customer", "c.*")  # one row
    full = full.join(orders, "product").join(F.broadcast(orders.agg(F.max("n").alias("most"))))  # one row
    return full.select("customer", "product", *[F.round(F.coalesce(c, F.lit(0.0)), 9).alias(n) for c, n in ((F.col("repeat"), "repeat"), (F.col("near"), "copurchase"), (F.col("n") / F.col("most"), "popular"))])


def ranked(signals: DataFrame, weights: tuple[float, float, float] = (1.0, 0.6, 0.5), k: int = 10) -> DataFrame:
    """The k best products of each customer with score (4 digits), rank and reason; ties go to the lower product."""
    repeat, co, popular = weights
    score = F.round(F.col("repeat") * repeat + F.col("copurchase") * co + F.col("popular") * popular, 4)
    reason = F.when(F.col("repeat") > 0, "repeat").when(F.col("copurchase") > 0, "copurchase").otherwise("popular")
    w = W.partitionBy("customer").orderBy(F.desc("score"), "product")
    return signals.select("customer", "product", score.alias("score"), reason.alias("reason")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranking_metrics(lists: DataFrame, bought: DataFrame, n_products: int, k: int = 10) -> DataFrame:
    """precision, recall, hit rate and coverage of recommendation lists against what was bought; one row.

    Customers without purchases do not count; a customer with a list but no hit counts as 0.
    """
    truth = bought.select("customer", "product").distinct()
    hits = lists.join(truth, ["customer", "product"], "left_semi").groupBy("customer").agg(F.count("*").alias("h"))
    per = truth.groupBy("customer").agg(F.count("*").alias("t")).join(lists.select("customer").distinct(), "customer", "left_semi").join(hits, "customer", "left").fillna(0, ["h"])
    shown = lists.agg(F.count_distinct("product").alias("shown"))
    g = per.agg(F.count("*").alias("customers"), F.avg(F.col("h") / k).alias("p"), F.avg(F.col("h") / F.col("t")).alias("r"), F.avg((F.col("h") > 0).cast("int")).alias("hit"))
    return g.join(F.broadcast(shown)).select("customers", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round("hit", 4).alias("hit_rate"), F.round(F.col("shown") / n_products, 4).alias("coverage"))


def choose_weights(signals: DataFrame, bought: DataFrame, n_products: int, grid: list[tuple[float, float, float]], k: int = 10) -> DataFrame:
    """Metrics of every weighting of the grid (a fixed short list), best precision, then recall, first.

    A customer's candidates are one array, ranked once per weighting where they are: only customers are shuffled, not
    candidates times weightings.
    """
    truth = bought.select("customer", "product").distinct()
    sizes = truth.groupBy("customer").agg(F.count("*").alias("t"))
    marked = signals.join(truth.withColumn("b", F.lit(1)), ["customer", "product"], "left")
    lists = marked.groupBy("customer").agg(F.collect_list(F.struct("product", "repeat", "copurchase", "popular", "b")).alias("c")).join(sizes, "customer")

    def hits(wr: float, wc: float, wp: float):
        scored = F.transform("c", lambda x: F.struct((-F.round(x["repeat"] * wr + x["copurchase"] * wc + x["popular"] * wp, 4)).alias("s"), x["product"].alias("p"), x["b"].alias("b")))
        return F.size(F.filter(F.slice(F.array_sort(scored), 1, k), lambda x: x["b"].isNotNull()))

    each = F.array(*[F.struct(F.lit(i).alias("g"), *[F.lit(float(v)).alias(n) for n, v in zip(("wr", "wc", "wp"), w)], hits(*w).alias("h")) for i, w in enumerate(grid)])
    x = lists.select("t", F.explode(each).alias("e")).select("t", "e.*")
    g = x.groupBy("g", "wr", "wc", "wp").agg(F.round(F.avg(F.col("h") / k), 6).alias("precision"), F.round(F.avg(F.col("h") / F.col("t")), 6).alias("recall"))
    return g.orderBy(F.desc("precision"), F.desc("recall"), "g").drop("g")
