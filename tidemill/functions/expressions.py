"""Expressions shared by the marts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int | None = 4) -> Column:
    """a / b, rounded unless `digits` is None; null where b is not positive."""
    share = a.cast("double") / b.cast("double")
    return F.when(b > 0, share if digits is None else F.round(share, digits))


def money(c: Column) -> Column:
    """An amount in whole cents, null as 0; exact, so sums do not depend on their order."""
    return F.coalesce(c, F.lit(0)).cast("decimal(18,2)")


def tri_state(c: Column) -> Column:
    """'true', 'false', or null where the condition is unknown."""
    return F.when(c, "true").when(~c, "false")


def week_start(c: Column) -> Column:
    """The Monday of a date's week."""
    return F.date_trunc("week", c).cast("date")


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + 8, carried back by the recurrence."""
    y, shift = x + 8.0, x
    for i in range(1, 8):
        shift = shift * (x + float(i))
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(shift)


def _poisson_log(k: Column, mu: Column) -> Column:
    """ln P(X = k) of a Poisson variable; in logarithms, so no mean is too large."""
    return k * F.log(mu) - mu - log_gamma(k + 1.0)


def _falling_sum(steps: Column, ratio_at) -> Column:
    """1 + r(1) + r(1) r(2) + ...: the sum of a tail whose first term is 1 and whose terms shrink by ratio_at(i)."""
    return F.aggregate(
        F.sequence(F.lit(1), steps.cast("int")),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, i: F.struct((a["t"] * ratio_at(i)).alias("t"), (a["s"] + a["t"] * ratio_at(i)).alias("s")),
        lambda a: a["s"],
    )


def _poisson_sides(k: Column, mu: Column) -> tuple[Column, Column]:
    """P(X >= k) summed upwards, right for k > mu, and P(X < k) summed downwards, right for k <= mu.

    Terms fall like exp(-i^2 / 2k), so 9 standard deviations of them leave nothing that a double holds.
    """
    x, m = k.cast("double"), mu.cast("double")
    steps = F.ceil(9 * F.sqrt(F.greatest(x, m))) + 60
    up = F.exp(_poisson_log(x, m)) * _falling_sum(steps, lambda i: m / (x + i))
    below = F.greatest(x - 1, F.lit(0.0))
    down = F.exp(_poisson_log(below, m)) * _falling_sum(steps, lambda i: F.greatest(below - i + 1, F.lit(0.0)) / m)
    return up, down


def poisson_tail(k: Column, mu: Column) -> Column:
    """P(X >= k) of a Poisson variable of mean mu >= 0, on the JVM; each side is summed away from the mode, in logarithms."""
    up, down = _poisson_sides(k, mu)
    return F.when(k.isNull() | mu.isNull(), None).when(k <= 0, 1.0).when(mu <= 0, 0.0).when(k > mu, F.least(up, F.lit(1.0))).otherwise(F.greatest(1 - down, F.lit(0.0)))


def poisson_low(k: Column, mu: Column) -> Column:
    """P(X <= k) of a Poisson variable of mean mu >= 0."""
    up, down = _poisson_sides(k + 1, mu)
    return F.when(k.isNull() | mu.isNull(), None).when(k < 0, 0.0).when(mu <= 0, 1.0).when(k + 1 > mu, F.greatest(1 - up, F.lit(0.0))).otherwise(F.least(down, F.lit(1.0)))


def _beta_share(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) for x < (a + 1) / (a + b + 2), by its continued fraction.

    Evaluated from the inside, over 4 sqrt(max(a, b)) + 40 pairs of terms: more than it takes to converge there.
    """

    def term(i: Column) -> Column:
        m = F.floor(i / 2)
        even = m * (b - m) / ((a + i - 1) * (a + i))
        odd = -(a + m) * (a + b + m) / ((a + i - 1) * (a + i))
        return F.when(i % 2 == 0, even).otherwise(odd) * x

    pairs = (F.ceil(4 * F.sqrt(F.greatest(a, b))) + 40).cast("int")
    fraction = F.aggregate(F.sequence(2 * pairs, F.lit(1), F.lit(-1)), F.lit(1.0), lambda t, i: 1 + term(i) / t)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    return front / (a * fraction)


def _nb_sides(k: Column, mu: Column, alpha: Column) -> tuple[Column, Column]:
    """P(X <= k) and P(X > k) of a negative binomial variable of mean mu and variance mu + alpha mu^2."""
    r, m, a = 1 / alpha.cast("double"), mu.cast("double"), k.cast("double") + 1
    p = r / (r + m)
    near = p < (r + 1) / (r + a + 2)
    low = F.when(near, _beta_share(r, a, p)).otherwise(1 - _beta_share(a, r, 1 - p))
    high = F.when(near, 1 - _beta_share(r, a, p)).otherwise(_beta_share(a, r, 1 - p))
    return low, high


def count_low(k: Column, mu: Column, alpha: Column) -> Column:
    """P(X <= k) of a negative binomial count, of a Poisson one where alpha is at most 1e-6."""
    low, _ = _nb_sides(k, mu, alpha)
    return F.when(k.isNull() | mu.isNull() | alpha.isNull(), None).when(alpha <= 1e-6, poisson_low(k, mu)).when(k < 0, 0.0).when(mu <= 0, 1.0).otherwise(F.greatest(F.least(low, F.lit(1.0)), F.lit(0.0)))


def count_tail(k: Column, mu: Column, alpha: Column) -> Column:
    """P(X >= k) of the same."""
    _, high = _nb_sides(k - 1, mu, alpha)
    return F.when(k.isNull() | mu.isNull() | alpha.isNull(), None).when(alpha <= 1e-6, poisson_tail(k, mu)).when(k <= 0, 1.0).when(mu <= 0, 0.0).otherwise(F.greatest(F.least(high, F.lit(1.0)), F.lit(0.0)))
