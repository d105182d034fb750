import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions.quantiles import exact_median, exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.51, 0.9, 0.999, 1.0]


def quantiles(df, by=()):
    return {
        (*[r[b] for b in by], r["p"]): r["quantile"]
        for r in exact_quantiles(df, "x", PROBS, by).collect()
    }


def test_matches_builtin_with_a_third_of_rows_equal(spark):
    noise = F.randn(3) * F.exp(F.randn(5) * 5)
    df = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(noise).alias("x"),
        (F.col("id") % 2).alias("g"),
    ).persist()
    found = quantiles(df, ["g"])
    builtin = df.groupBy("g").agg(F.percentile("x", F.array(*[F.lit(p) for p in PROBS])).alias("q"))
    for row in builtin.collect():
        for p, want in zip(PROBS, row["q"]):
            assert found[(row["g"], p)] == pytest.approx(want, rel=1e-12, abs=1e-300)
    df.unpersist()


def test_extremes_missing_and_signs(spark):
    values = [None, float("nan"), 2.0, 4.0, 8.0, -0.0, 5e-324, -5e-324, 1.7e308, -3.0, -3.0000000001]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    kept = np.array([v for v in values if v is not None and v == v])
    found = quantiles(df)
    for p in PROBS:
        assert found[(p,)] == pytest.approx(np.quantile(kept, p), rel=1e-9, abs=1e-300)


def test_neighbours_around_powers_of_two_keep_their_order(spark):
    values = []
    for k in (-3, 0, 1, 10, 52):
        x = 2.0**k
        values += [np.nextafter(x, 0), x, np.nextafter(x, np.inf), x * (1 + 1 / 1024), -x]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for i, p in enumerate(np.linspace(0, 1, len(values))):
        got = exact_quantiles(df, "x", [float(p)]).first()["quantile"]
        assert got == pytest.approx(np.quantile(values, p), rel=1e-15)
        if i > 6:
            break


def test_null_groups_and_empty_input(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", 2.0), ("a", 3.0)], "g string, x double")
    assert [tuple(r) for r in exact_median(df, "x", ["g"]).collect()] == [("a", 2.5)]
    assert exact_median(df.where("x > 9"), "x").collect() == []
