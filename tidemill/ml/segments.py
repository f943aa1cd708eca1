"""Customer segments: features, choice of k, profiles, agreement of two groupings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def scaled(df: DataFrame, key: str, skewed: Sequence[str], shares: Sequence[str] = ()) -> DataFrame:
    """(key, features): log1p of the skewed columns and the shares as they are, each by its mean and population deviation.

    Nulls count as 0, a constant column becomes 0. One aggregation gives all moments.
    """
    values = {c: F.log1p(F.coalesce(F.col(c), F.lit(0)).cast("double")) for c in skewed} | {c: F.coalesce(F.col(c), F.lit(0)).cast("double") for c in shares}
    x = df.select(key, *[v.alias(c) for c, v in values.items()])
    moments = x.agg(*[f(c).alias(f"__{n}_{c}") for c in values for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = x.join(F.broadcast(moments)).select(key, *[F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")), F.lit(0.0)).alias(c) for c in values])  # one row
    return VectorAssembler(inputCols=list(values), outputCol="features").transform(z).select(key, "features", *values)


def choose_k(z: DataFrame, ks: Sequence[int] = range(3, 9), seed: int = 7) -> list[tuple[int, float, KMeansModel]]:
    """(k, silhouette, model) for every k, by the squared Euclidean silhouette; the input is cached for the passes."""
    z = z.select("features").persist()
    try:
        out = []
        for k in ks:
            model = KMeans(k=k, seed=seed, maxIter=20).fit(z)
            out.append((k, ClusteringEvaluator().evaluate(model.transform(z)), model))
        return out
    finally:
        z.unpersist()


def adjusted_rand(df: DataFrame, one: str, two: str) -> DataFrame:
    """(n, ari): the adjusted Rand index of two groupings of the same rows, from their contingency table; null for one row."""
    pairs = lambda c: c * (c - 1) / 2.0
    cells = df.groupBy(one, two).agg(F.count("*").alias("c"))
    rows, columns = cells.groupBy(one).agg(F.sum("c").alias("c")), cells.groupBy(two).agg(F.sum("c").alias("c"))
    total = lambda x, n: x.agg(F.sum(pairs(F.col("c"))).alias(n))
    g = cells.agg(F.sum("c").alias("n"), F.sum(pairs(F.col("c"))).alias("both")).join(F.broadcast(total(rows, "a"))).join(F.broadcast(total(columns, "b")))  # one row each
    expected, most = F.col("a") * F.col("b") / pairs(F.col("n")), (F.col("a") + F.col("b")) / 2
    return g.select("n", F.when(F.col("n") > 1, F.coalesce(F.try_divide(F.col("both") - expected, most - expected), F.lit(1.0))).alias("ari"))


def profiles(df: DataFrame, segment: str, features: Sequence[str], least: float = 0.5) -> DataFrame:
    """Per segment: size, share, mean of each feature, and its traits: features whose mean lies over `least` sample deviations above everyone's."""
    every = df.agg(*[f(c).alias(f"__{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    g = df.groupBy(segment).agg(F.count("*").alias("size"), *[F.avg(c).alias(c) for c in features]).join(F.broadcast(every))  # one row
    z = {c: F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c in features}
    traits = F.array_join(F.array_compact(F.array(*[F.when(v > least, F.lit(c)) for c, v in z.items()])), "|")
    share = F.col("size") / F.sum("size").over(W.partitionBy())  # one row per segment
    return g.select(segment, "size", F.round(share, 4).alias("share"), *[F.round(c, 4).alias(c) for c in features], traits.alias("traits"))
