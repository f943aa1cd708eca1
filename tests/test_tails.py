import math

import pytest
from pyspark.sql import functions as F

from tidemill.functions.expressions import count_low, count_tail, poisson_low, poisson_tail


def poisson(k, mu):
    return math.fsum(math.exp(i * math.log(mu) - mu - math.lgamma(i + 1)) for i in range(k + 1)) if k >= 0 else 0.0


def binomial(k, mu, alpha):
    r, p = 1 / alpha, 1 / (1 + alpha * mu)
    return math.fsum(math.exp(math.lgamma(i + r) - math.lgamma(i + 1) - math.lgamma(r) + r * math.log(p) + i * math.log1p(-p)) for i in range(k + 1)) if k >= 0 else 0.0


ROWS = [(max(0, int(mu + z * math.sqrt(mu))), mu, alpha) for mu in (0.05, 1.0, 3.7, 50.0, 900.0, 5000.0) for z in (-6, -1, 0, 1, 6) for alpha in (0.0, 0.02, 1.5)]


def test_against_the_definition(spark):
    k, mu, a = (F.col(c) for c in ("k", "mu", "a"))
    df = spark.createDataFrame(ROWS, "k int, mu double, a double")
    for r in df.select(k, mu, a, poisson_tail(k, mu).alias("pt"), poisson_low(k, mu).alias("pl"), count_tail(k, mu, a).alias("ct"), count_low(k, mu, a).alias("cl")).collect():
        assert math.isclose(r.pl, poisson(r.k, r.mu), abs_tol=1e-9) and math.isclose(r.pt, 1 - poisson(r.k - 1, r.mu), abs_tol=1e-9)
        low = binomial if r.a else (lambda k, mu, _: poisson(k, mu))
        assert math.isclose(r.cl, low(r.k, r.mu, r.a), abs_tol=1e-8) and math.isclose(r.ct, 1 - low(r.k - 1, r.mu, r.a), abs_tol=1e-8)


@pytest.mark.parametrize("mu", [900.0, 1e5, 1e6])
def test_large_means_do_not_underflow(spark, mu):
    k, m = F.lit(int(mu)), F.lit(mu)
    low, tail = spark.range(1).select(poisson_low(k, m), poisson_tail(k, m)).first()
    # At the mean of a large Poisson variable: a half, corrected by the skewness and half the probability of the point itself.
    assert abs(low - 0.5 - 2 / 3 / math.sqrt(2 * math.pi * mu)) < 1e-5 and abs(low + tail - 1 - 1 / math.sqrt(2 * math.pi * mu)) < 1e-5


def test_small_tails_keep_their_digits(spark):
    got = spark.range(1).select(poisson_tail(F.lit(60), F.lit(10.0))).first()[0]
    want = math.fsum(math.exp(i * math.log(10) - 10 - math.lgamma(i + 1)) for i in range(60, 200))
    assert math.isclose(got, want, rel_tol=1e-9)


def test_edges(spark):
    row = spark.range(1).select(poisson_tail(F.lit(0), F.lit(3.0)), poisson_tail(F.lit(2), F.lit(0.0)), poisson_low(F.lit(-1), F.lit(3.0)), poisson_low(F.lit(0), F.lit(0.0)), count_tail(F.lit(0), F.lit(3.0), F.lit(0.5)), count_low(F.lit(-1), F.lit(3.0), F.lit(0.5)), poisson_tail(F.lit(None).cast("int"), F.lit(3.0))).first()
    assert list(row) == [1.0, 0.0, 0.0, 1.0, 1.0, 0.0, None]
