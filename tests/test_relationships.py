import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.operators import relationships as rel


def test_constant_column_is_dropped_and_correlation_matches(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=200)
    frame = pd.DataFrame({"a": a, "b": a * 0.5 + rng.normal(size=200), "c": 1.0})
    frame.loc[::7, "a"] = np.nan
    frame.loc[::5, "b"] = np.nan
    df = spark.createDataFrame(frame)
    got = rel.numeric_numeric(df, [("a", "b"), ("a", "c")], min_score=0.0).collect()
    assert len(got) == 1
    assert got[0]["metric_value"] == pytest.approx(round(frame.a.corr(frame.b), 4))
    assert got[0]["rows_used"] == len(frame[["a", "b"]].dropna())
    swapped = rel.numeric_numeric(df, [("b", "a")], min_score=0.0).first()
    assert swapped["score"] == got[0]["score"]


def test_fifteen_rows_are_needed(spark):
    for n, found in ((14, 0), (15, 1)):
        df = spark.range(n).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
        assert rel.numeric_numeric(df, [("a", "b")]).count() == found


def test_small_groups_do_not_compete_but_count_for_the_deviation(spark):
    rows = [("a", float(i % 3)) for i in range(10)] + [("b", 1.0 + i % 3) for i in range(10)]
    rows += [("tiny", 100.0)] * 2 + [(None, 50.0)] * 4 + [("a", None)] * 3
    df = spark.createDataFrame(rows, "g string, x double")
    frame = pd.DataFrame(rows, columns=["g", "x"]).dropna()
    groups = frame.groupby("g").x.agg(["mean", "median", "count"])
    groups = groups[groups["count"] >= 3]
    want = (groups["mean"].max() - groups["mean"].min()) / frame.x.std()
    measured = rel.category_numeric_effects(rel.group_moments(df, ["g"], ["x"])).first()
    assert measured["effect"] == pytest.approx(want)
    assert measured["rows_used"] == len(frame)
    assert (measured["top_group"], measured["bottom_group"]) == ("b", "a")
    found = rel.categorical_numeric(df, [("g", "x")], min_score=0.0).first()
    assert {g["group"]: g["median"] for g in found["groups"]} == groups["median"].to_dict()


def test_equal_means_go_to_the_first_name(spark):
    rows = [(g, v) for g in ("b", "a", "c", "d") for v in ((1, 1, 0, 0) if g in "ab" else (0, 0, 0, 0))] * 3
    df = spark.createDataFrame(rows, "g string, y int")
    found = rel.categorical_binary(df, [("g", "y")]).first()
    assert (found["top_group"], found["bottom_group"]) == ("a", "c")
    assert found["metric_value"] == 0.5


def test_thresholds_on_both_sides(spark):
    def rate(hits):
        rows = [("a", int(i < hits)) for i in range(1000)] + [("b", 0)] * 1000
        return rel.categorical_binary(spark.createDataFrame(rows, "g string, y int"), [("g", "y")]).count()

    assert rate(49) == 0 and rate(50) == 1


def test_binary_needs_both_classes(spark):
    df = spark.range(40).select(F.lit(1).alias("b"), F.col("id").alias("x"))
    assert rel.binary_numeric(df, [("b", "x")]).count() == 0


def test_unparsable_dates_drop_out(spark):
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd")
    df = spark.range(60).select(
        F.when(F.col("id") % 4 == 0, "soon").otherwise(day).alias("seen"), F.col("id").alias("x")
    )
    found = rel.time_numeric(df, [("seen", "x")]).first()
    assert found["rows_used"] == 45 and found["score"] == 1.0 and found["direction"] == "increase"


def test_hot_group_and_many_pairs_in_tiles(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 4)).alias("g"),
        *[((F.col("id") * (i + 3)) % 101).alias(f"x{i}") for i in range(24)],
    )
    names = [f"x{i}" for i in range(24)]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    got = rel.numeric_numeric(df, pairs, min_score=0.0).select("column_a", "column_b", "metric_value").collect()
    frame = df.toPandas()
    corr = frame[names].corr()
    assert len(got) == len(pairs)
    for r in got[::17]:
        assert r["metric_value"] == pytest.approx(corr.loc[r["column_a"], r["column_b"]], abs=6e-5)


def test_booleans_count_as_zero_and_one_and_other_values_give_nothing(spark):
    df = spark.range(60).select(
        (F.col("id") % 2).cast("int").alias("number"), (F.col("id") % 2 == 1).alias("flag"),
        (F.col("id") % 3 * 0.5).alias("half"), (F.col("id") % 2 * 5.0 + F.col("id") % 7).alias("v"),
    )
    found = {r["column_a"]: r for r in rel.binary_numeric(df, [(c, "v") for c in ("number", "flag", "half")]).collect()}
    assert set(found) == {"number", "flag"}
    assert found["flag"]["metric_value"] == found["number"]["metric_value"]
    kinds = df.select(F.when(F.col("number") == 1, "a").otherwise("b").alias("kind"), "flag", (F.col("number") * 10).alias("ten"))
    rates = rel.categorical_binary(kinds, [("kind", "flag"), ("kind", "ten")]).collect()
    assert [r["column_b"] for r in rates] == ["flag"]


def test_a_failing_column_or_pair_leaves_the_others(spark):
    df = spark.range(60).select(
        F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"), (F.col("id") % 7).alias("z"),
        F.raise_error(F.lit("unreadable")).cast("double").alias("bad"),
    )
    pairs = {"numeric_numeric": [("x", "y"), ("x", "z"), ("bad", "x"), ("y", "gone"), ("z", "bad")]}
    findings, status = rel.findings_with_status(df, "d", pairs)
    got = {(r["column_a"], r["column_b"]): (r["status"], r["reason"]) for r in status.collect()}
    assert got == {
        ("x", "y"): ("retained", None), ("x", "z"): ("not_retained", None),
        ("bad", "x"): ("failed", "USER_RAISED_EXCEPTION"), ("z", "bad"): ("failed", "USER_RAISED_EXCEPTION"),
        ("y", "gone"): ("failed", "The column is not there."),
    }
    assert [(r["column_a"], r["column_b"]) for r in findings.collect()] == [("x", "y")]


def test_all_pairs_fail_or_none_are_there(spark):
    df = spark.range(30).select(F.raise_error(F.lit("no")).cast("double").alias("a"), F.col("id").alias("b"))
    findings, status = rel.findings_with_status(df, "d", {"numeric_numeric": [("a", "b")]})
    assert findings.isEmpty() and status.first()["status"] == "failed"
    findings, status = rel.findings_with_status(df, "d", {})
    assert findings.isEmpty() and status.isEmpty()
