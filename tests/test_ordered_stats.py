"""Ordered scans, p values and resampling against plain loops and closed forms."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stats
from corpusloom.operators import ordered, regression, resampling, vectors


@pytest.fixture(scope="module")
def scattered(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", None]) if k % 10 else "hot", rng.choice([None, *range(6)]), k // 2) for k in range(500)]  # each third value twice
    rows += [("hot", 3, 9999)] * 300
    return rows, spark.createDataFrame(rows, "g string, v int, k long").withColumn("count", F.lit(1)).repartition(7)


def key(r):
    return tuple((x is not None, x) for x in r)


def test_numbers_and_previous_rows(scattered):
    rows, frame = scattered
    order = sorted(rows, key=key)
    got = sorted(((r.n, (r.g, r.v, r.k)) for r in ordered.numbered(frame, ["g", "v", "k"], "n").collect()), key=lambda x: x[0])
    assert [n for n, _ in got] == list(range(len(rows))) and [r for _, r in got] == order
    pairs = [((r.g, r.v, r.k), None if r.previous is None else tuple(r.previous)) for r in ordered.with_previous(frame, ["g", "v", "k"], ["g", "k"]).collect()]
    want = [(b, None if a is None else (a[0], a[2])) for a, b in zip([None, *order], order, strict=False)]
    sort = lambda ps: sorted(ps, key=lambda p: (key(p[0]), key(p[1] or ())))
    assert sort(pairs) == sort(want)
    marked = sorted(ordered.border_flags(frame, ["g", "v", "k"], "g").collect(), key=lambda r: r.idx)
    assert [r.border for r in marked] == [k > 0 and order[k - 1][0] != order[k][0] for k in range(len(order))]
    none = frame.limit(0)
    assert ordered.numbered(none, ["k"]).count() == ordered.with_previous(none, ["k"], ["g"]).count() == ordered.border_flags(none, ["k"], "g").count() == 0
    one = frame.filter("k = 7").limit(1)
    assert [(r.idx, r.border) for r in ordered.border_flags(one, ["k"], "g").collect()] == [(0, False)]


def test_order_of_ties_is_the_same_in_every_run(scattered):
    _, frame = scattered
    runs = [{r.i: r.k for r in ordered.numbered(f, ["g"], "i").collect()} for f in (frame, frame.repartition(3))]
    assert runs[0] == runs[1]


def test_mean_ranks(scattered):
    rows, frame = scattered
    got = {(r.g, r.v): r["rank"] for r in ordered.mean_ranks(frame.dropna(), "v", ["g"]).collect()}
    for g in ("a", "b", "c", "hot"):
        values = sorted(v for h, v, _ in rows if h == g and v is not None)
        for v in set(values):
            assert got[g, v] == sum(k for k, x in enumerate(values, 1) if x == v) / values.count(v)


def t_closed(t, n):
    """Two-sided probability of Student's t by its finite sums."""
    theta = math.atan(t / math.sqrt(n))
    c, s = math.cos(theta), math.sin(theta)
    if n % 2:
        term, total = c, c if n > 1 else 0.0
        for k in range(3, n - 1, 2):
            term *= c * c * (k - 1) / k
            total += term
        return 1 - 2 / math.pi * (theta + s * total)
    term, total = 1.0, 1.0
    for k in range(2, n - 1, 2):
        term *= c * c * (k - 1) / k
        total += term
    return 1 - s * total


def test_p_values(spark):
    z = [0.0, 1e-6, 0.3, 1.0, 1.96, 2.0, 2.82, 2.83, 3.5, 6.0, 12.0, 25.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in z], "z double").select(stats.two_sided_p(F.col("z")).alias("p")).collect()]
    for x, p in zip(z, got, strict=True):
        assert abs(p - math.erfc(x / math.sqrt(2))) <= 1e-9 * math.erfc(x / math.sqrt(2)) + 1e-13
    odd = spark.createDataFrame([(float("nan"),), (None,), (-1.0,)], "z double").select(stats.two_sided_p(F.col("z")).alias("p")).collect()
    assert odd[0].p is None and odd[1].p is None and abs(odd[2].p - math.erfc(1 / math.sqrt(2))) < 1e-12
    cases = list(itertools.product([0.0, 0.1, 0.7, 1.5, 2.5, 4.0, 8.0], [1, 2, 3, 5, 10, 33, 100, 1001, 19_999, 20_000, 20_001, 100_000]))
    frame = spark.createDataFrame([(k, t, n) for k, (t, n) in enumerate(cases)], "k int, t double, n long")
    found = {r.k: r.p for r in frame.select("k", stats.t_two_sided(F.col("t"), F.col("n")).alias("p")).collect()}
    for k, (t, n) in enumerate(cases):
        assert abs(found[k] - t_closed(t, n)) < 1e-9, (t, n, found[k], t_closed(t, n))
    assert spark.range(1).select(stats.t_two_sided(F.lit(1.0), F.lit(0)).alias("p")).first().p is None
    gamma = spark.createDataFrame([(x,) for x in (0.5, 1.0, 3.5, 50.0, 1e6)], "x double").select("x", stats.log_gamma(F.col("x")).alias("g")).collect()
    assert all(abs(r.g - math.lgamma(r.x)) <= 1e-11 * max(1, abs(math.lgamma(r.x))) for r in gamma)


def test_spearman_and_consecutive_cosines(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(0, 9), rng.randint(0, 9)) for _ in range(200)] + [("c", 1, 2), ("c", 2, 3), ("d", 1, 1), ("d", 1, 2), ("d", 1, 3), ("a", None, 1), (None, 1, 1), ("e", 1, 3), ("e", 2, 2), ("e", 3, 1)]
    got = {r.g: r for r in regression.spearman(spark.createDataFrame(rows, "g string, x int, y int"), "x", "y", ["g"]).collect()}

    def ranks(v):
        s = sorted(v)
        return [s.index(x) + (s.count(x) + 1) / 2 for x in v]

    for g in "ab":
        x, y = (ranks([r[k] for r in rows if r[0] == g and r[1] is not None]) for k in (1, 2))
        n, mx, my = len(x), sum(x) / len(x), sum(y) / len(y)
        rho = sum((p - mx) * (q - my) for p, q in zip(x, y, strict=True)) / math.sqrt(sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y))
        assert got[g].n == n and abs(got[g].rho - rho) < 1e-9
        assert abs(got[g].p_value - t_closed(abs(rho) * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)) < 1e-8
    assert got["c"].p_value is None and got["d"].rho is None and (got["e"].rho, got["e"].p_value) == (-1.0, 0.0) and set(got) == set("abcde")
    points = [("a", 1, [1.0, 0.0]), ("a", 2, [1.0, 1.0]), ("b", 0, [0.0, 1.0]), ("a", 5, [0.0, 0.0]), ("b", 3, [0.0, 2.0])]
    cos = vectors.consecutive_cosines(spark.createDataFrame(points, "g string, n int, v array<double>"), ["g"], "n", "v").collect()
    assert sorted((r.g, r.previous, r.n, round(r.cosine, 9)) for r in cos) == [("a", 1, 2, round(math.sqrt(0.5), 9)), ("a", 2, 5, 0.0), ("b", 0, 3, 1.0)]


def test_draws_follow_the_binomial_distribution(spark):
    rows = [("a", 30, 100), ("b", 0, 0), ("c", 0, 7), ("d", 7, 7), ("e", 1, 2), ("f", 400_000, 1_000_000)]
    frame = spark.createDataFrame(rows, "k string, c int, n int")
    draws = resampling.binomial_draws(frame, "k", "c", "n", 4000, 42)
    one, two = ({(r.key, r.draw): r.k for r in resampling.binomial_draws(f, "k", "c", "n", 4000, 42).collect()} for f in (frame, frame.orderBy(F.desc("k")).repartition(5)))
    assert one == two and len(one) == 6 * 4000 and draws.filter("key = 'a'").select("k").distinct().count() > 20
    assert {v for (k, _), v in one.items() if k in "bc"} == {0} and {v for (k, _), v in one.items() if k == "d"} == {7}
    # Each draw is the least number whose cumulative probability reaches its uniform number.
    cdf, total = [], 0.0
    for k in range(101):
        total += math.comb(100, k) * 0.3**k * 0.7 ** (100 - k)
        cdf.append(total)
    numbers = {r.d: r.u for r in spark.range(1, 4001).select(F.col("id").alias("d"), resampling.uniform(F.lit("a"), F.col("id"), 42).alias("u")).collect()}
    assert all(one["a", d] == next(k for k, f in enumerate(cdf) if f >= u) for d, u in numbers.items() if min(abs(f - u) for f in cdf) > 1e-12)
    wide = [v for (k, _), v in one.items() if k == "f"]
    mean, spread = sum(wide) / len(wide), math.sqrt(sum((v - 400_000) ** 2 for v in wide) / len(wide))
    assert abs(mean - 400_000) < 5 * 490 / math.sqrt(4000) and abs(spread / 489.9 - 1) < 0.05
    out = {r.key: r for r in resampling.bootstrap(frame, "k", "c", "n").collect()}
    assert 0.19 < out["a"].low < 0.24 and 0.36 < out["a"].high < 0.41 and out["b"].high == 0
