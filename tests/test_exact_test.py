import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sightline.functions.scalars import ln_factorial
from sightline.operators.exact_test import fisher_exact


def brute(a, b, c, d):
    def ways(x):
        return math.comb(a + b, x) * math.comb(c + d, a + c - x)

    support = range(max(0, a + c - (c + d)), min(a + b, a + c) + 1)
    limit, total = ways(a) * (10**7 + 1) // 10**7, math.comb(a + b + c + d, a + c)
    return float(Fraction(sum(ways(x) for x in support if ways(x) <= limit), total))


TABLES = [
    (8, 2, 1, 5), (0, 5, 5, 0), (3, 3, 3, 3), (10, 0, 0, 0), (0, 0, 4, 6), (1, 0, 0, 1),
    (120, 30, 80, 70), (500, 20, 480, 40), (900, 600, 880, 640),
]


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(TABLES)], "k int, a int, b int, c int, d int")
    found = {r["k"]: r["p_value"] for r in fisher_exact(df, "a", "b", "c", "d", ["k"]).collect()}
    for i, t in enumerate(TABLES):
        assert found[i] == pytest.approx(brute(*t), rel=1e-7, abs=1e-300), t
        assert 0 <= found[i] <= 1
    assert found[0] == pytest.approx(0.034965, abs=1e-6)


def test_swapping_rows_changes_nothing_and_large_counts_work(spark):
    df = spark.createDataFrame(
        [(1, 400000, 600000, 401000, 599000), (2, 401000, 599000, 400000, 600000), (3, 900000, 10, 10, 900000)],
        "k int, a long, b long, c long, d long",
    )
    p = {r["k"]: r["p_value"] for r in fisher_exact(df, "a", "b", "c", "d", ["k"]).collect()}
    assert p[1] == pytest.approx(p[2], rel=1e-6)
    # The normal approximation with continuity correction is close at this size.
    rate = 801000 / 2e6
    sd = math.sqrt(rate * (1 - rate) * 1e6 / 2)
    z = (500 - 0.5) / sd
    assert p[1] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=0.02)
    assert p[3] == 0.0


def test_ln_factorial(spark):
    ns = [0, 1, 2, 5, 19, 20, 21, 100, 10**6, 10**9]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    for r in df.select("n", ln_factorial(F.col("n")).alias("v")).collect():
        assert r["v"] == pytest.approx(math.lgamma(r["n"] + 1), rel=1e-13, abs=1e-13)
