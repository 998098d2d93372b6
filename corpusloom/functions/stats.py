"""Statistics as Spark columns."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def wilson(successes: Column, n: Column, alpha: float = 0.05) -> Column:
    """Struct (low, high) of Wilson's score interval; (0, 0) without trials."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    p, m = ratio(successes, n), n.cast("double")
    middle = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    some = n > 0
    return F.struct(
        F.when(some, F.greatest(middle - half, F.lit(0.0))).otherwise(0.0).alias("low"),
        F.when(some, F.least(middle + half, F.lit(1.0))).otherwise(0.0).alias("high"),
    )


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Pooled z statistic; 0 where the pooled error is 0."""
    pool = ratio(x1 + x2, n1 + n2)
    error = F.sqrt(pool * (1 - pool) * (ratio(F.lit(1), n1) + ratio(F.lit(1), n2)))
    return F.when(error > 0, (ratio(x1, n1) - ratio(x2, n2)) / error).otherwise(0.0)


def erfc(x: Column, terms: int = 80) -> Column:
    """Complementary error function of a number that isn't negative, to some 1e-13: a series of positive terms up to 2, a continued fraction beyond."""
    square = x * x
    step = lambda s, k: F.struct((s["t"] * 2 * square / (2 * k + 1)).alias("t"), (s["sum"] + s["t"] * 2 * square / (2 * k + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(x.alias("t"), x.alias("sum")), step, lambda s: s["sum"])
    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-square) * series
    far = F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), x, lambda f, k: x + k / 2 / f)
    return F.when(x < 2, near).otherwise(F.exp(-square) / math.sqrt(math.pi) / far)


def two_sided_p(z: Column) -> Column:
    """Probability of a normal deviate at least as far from 0; null for null or NaN."""
    return F.when(~F.isnan(z), erfc(F.abs(z) / math.sqrt(2)))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series after eight steps up."""
    up = x + 8
    series = 1 / (12 * up) - 1 / (360 * up * up * up) + 1 / (1260 * up * up * up * up * up) - 1 / (1680 * F.pow(up, F.lit(7)))
    steps = x
    for k in range(1, 8):
        steps = steps * (x + k)
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def incomplete_beta(a: Column, b: Column, x: Column, terms: int = 200) -> Column:
    """Regularised incomplete beta function, for x in [0, 1], by its continued fraction from the far end."""

    def fraction(a: Column, b: Column, x: Column) -> Column:
        even = lambda m: m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = lambda m: -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        tail = F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), F.lit(1.0), lambda f, m: 1 + even(m) / (1 + odd(m) / f))
        front = F.exp(a * F.log(x) + b * F.log(1 - x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a
        return front / (1 + odd(F.lit(0)) / tail)

    inside = F.when(x < (a + 1) / (a + b + 2), fraction(a, b, x)).otherwise(1 - fraction(b, a, 1 - x))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


#: From so many degrees of freedom on, Hill's expansion to a normal deviate (1970) is exact to double precision.
MANY = 20_000


def t_two_sided(t: Column, df: Column) -> Column:
    """Probability that Student's t with ``df`` degrees of freedom is at least as far from 0; null without any."""
    d = df.cast("double")
    a = d - 0.5
    y = a * F.log1p(t * t / d)
    b = 48 * a * a
    z = ((((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b) + y + 3.0) / b + 1.0
    return F.when(d >= MANY, erfc(z * F.sqrt(y) / math.sqrt(2))).when(d > 0, incomplete_beta(d / 2, F.lit(0.5), d / (d + t * t)))


def overlap(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    """Whether closed intervals meet."""
    return (low1 <= high2) & (low2 <= high1)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    pairs = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """0 where a norm is under 1e-10. Norms known already can be given."""
    na, nb = norm(a) if na is None else na, norm(b) if nb is None else nb
    return F.when((na < 1e-10) | (nb < 1e-10), 0.0).otherwise(dot(a, b) / (na * nb))


def histogram_bin(value: Column, most: float, bins: int) -> Column:
    """Bin 1 to ``bins`` of [0, most]; larger values are clipped and the last bin is closed."""
    v = F.least(value.cast("double"), F.lit(float(most)))
    return F.least(F.floor(v * bins / most) + 1, F.lit(bins)).cast("int")


def upper_median(name: str) -> Column:
    """Aggregate: element n // 2 of a column's sorted values, which tasks count by value first; a double."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def kl_divergence(p: Column, q: Column, eps: float = 1e-10) -> Column:
    """One term: both clipped from below, natural logarithm."""
    clip = lambda c: F.greatest(c, F.lit(eps))
    return clip(p) * F.log(clip(p) / clip(q))
