"""Hypergeometric tails inside a row against exact fractions."""

import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from meshflux.functions.inference import hypergeometric_tail, log_factorial


def exact(o, n, m, d):
    if o <= 0:
        return 1.0
    total = math.comb(n, d)
    return float(sum(Fraction(math.comb(m, i) * math.comb(n - m, d - i), total) for i in range(max(o, m + d - n, 0), min(m, d) + 1)))


def test_tails(spark):
    draw, rows = random.Random(1), [(0, 10, 3, 4), (4, 10, 3, 4), (3, 10, 3, 3), (1, 1, 1, 1), (5, 10, 10, 5), (2, 10, 0, 5), (-1, 5, 2, 2), (1, 5, 5, 1), (2, 5, 4, 4), (3, 5, 4, 4)]
    for _ in range(300):
        n = draw.choice([5, 40, 700, 6000])
        m, d = draw.randrange(n + 1), draw.randrange(n + 1)
        rows.append((draw.randrange(min(m, d) + 2), n, m, d))
        mean = d * m // n
        rows.append((max(0, mean + draw.randrange(-3, 8)), n, m, d))
    found = hypergeometric_tail(spark.createDataFrame(rows, "o long, n long, m long, d long"), "o", "n", "m", "d").collect()
    for r in found:
        want = exact(r.o, r.n, r.m, r.d)
        assert abs(r.p_value - want) <= 1e-9 * want + 1e-300, (r, want)


def test_long_tails_and_nulls(spark):
    """Counts of millions: the tail at the mean is about a half, and a null count has no tail."""
    rows = [(250_000, 4_000_000, 1_000_000, 1_000_000), (1, None, 3, 3), (None, 9, 3, 3), (1, 0, 0, 0)]
    found = hypergeometric_tail(spark.createDataFrame(rows, "o long, n long, m long, d long"), "o", "n", "m", "d").collect()
    assert abs(found[0].p_value - 0.5) < 2e-3 and found[1].p_value is None and found[3].p_value == 0.0


def test_log_factorial(spark):
    got = spark.range(0, 200).select("id", log_factorial(F.col("id")).alias("lf")).collect()
    assert all(abs(r.lf - math.lgamma(r.id + 1)) <= 1e-13 * max(1.0, math.lgamma(r.id + 1)) for r in got)
