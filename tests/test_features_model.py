import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import features, likelihood
from sightline.sources import tables as t


def test_age_edges(spark):
    ages = [0.0, 18.0, 18.5, 25.0, 120.0, 121.0, -1.0, None]
    df = spark.createDataFrame([(a,) for a in ages], "age double")
    got = [r["age_group"] for r in features.create_features(df).collect()]
    assert got == ["0-18", "0-18", "19-25", "19-25", "66+", None, None, None]


def test_boolean_share(spark):
    rows = [("yes" if i < 79 else "x", "no" if i < 80 else "x") for i in range(100)] + [(None, None)] * 20
    df = spark.createDataFrame(rows, "below string, reached string")
    assert features.plan_features(df).boolean_like == ["reached"]
    got = features.convert_boolean_like(df).where("reached = 0").count()
    assert got == 80


def test_status_words_are_not_booleans(spark):
    rows = [("no", "none"), ("yes", "employed"), (None, None), (" No Insurance ", "Jobless")]
    df = spark.createDataFrame(rows, "insurance_status string, employment_status string")
    made = features.create_features(df).collect()
    assert [r["no_health_insurance"] for r in made] == [1, 0, 0, 1]
    assert [r["unemployed"] for r in made] == [1, 0, 0, 1]
    assert [r["high_social_determinant_burden"] for r in made] == [1, 0, 0, 1]


def test_existing_flags_are_kept_and_missing_income_is_not_low(spark):
    df = spark.createDataFrame(
        [(10.0, 5), (None, 6), (30.0, 7)], "income double, unemployed int"
    ).withColumn("employment_status", F.lit("jobless"))
    made = features.create_features(df).orderBy("unemployed").collect()
    assert [r["low_income"] for r in made] == [1, 0, 0]
    assert [r["unemployed"] for r in made] == [5, 6, 7]


def test_text_target_words(spark):
    df = spark.createDataFrame([("Positive ",), ("negative",), ("maybe",), (None,)], "outcome string")
    assert [r["outcome"] for r in features.create_features(df).collect()] == [1, 0, None, None]


def test_split_takes_the_exact_share_of_each_class(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    split = likelihood.stratified_split(df, "y", ["id"], 0.2)
    got = {(r["y"], r["is_test"]): r["count"] for r in split.groupBy("y", "is_test").count().collect()}
    assert got == {(0, True): 180, (0, False): 720, (1, True): 20, (1, False): 80}
    again = likelihood.stratified_split(df.repartition(5), "y", ["id"], 0.2)
    assert {r["id"] for r in again.where("is_test").collect()} == {r["id"] for r in split.where("is_test").collect()}


def test_refusals(spark):
    one = spark.createDataFrame([(1, 1.0, 1)] * 30, "k int, x double, y int")
    assert likelihood.fit_logistic(one, ["x"], "y", ["k"]).status == "refused"
    assert likelihood.fit_logistic(one, [], "y", ["k"]).reason.startswith("No usable feature")


def test_model_separates_and_handles_unseen_and_missing(spark):
    df = spark.range(400).select(
        "id",
        F.when(F.col("id") % 11 != 0, (F.col("id") % 2) * 2.0 + F.rand(7)).alias("x"),
        F.when(F.col("id") % 13 != 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("c"),
        (F.col("id") % 2).alias("y"),
    )
    fitted = likelihood.fit_logistic(df, ["x", "c"], "y", ["id"])
    assert fitted.status == "fitted" and (fitted.train_rows, fitted.test_rows) == (320, 80)
    report = {r["label"]: r for r in fitted.report.collect()}
    assert report["accuracy"]["f1_score"] > 0.9 and report["macro avg"]["support"] == 80
    assert fitted.sample.count() == 20


def test_rates(spark, tiny):
    rates = likelihood.group_rates(t.graded(spark, tiny), "lang", "target")
    got = rates.collect()
    assert got == sorted(got, key=lambda r: (-r["percent_rate"], r["lang"]))
    gap = likelihood.rate_gap(rates, "lang").first()
    assert gap["top_group"] == got[0]["lang"] and gap["bottom_group"] == got[-1]["lang"]


def test_features_without_values_are_left_out_and_fractions_are_refused(spark):
    df = spark.range(200).select(
        "id", (F.col("id") % 2 + F.rand(3)).alias("x"), F.lit(None).cast("double").alias("none"),
        (F.col("id") % 2).alias("y"), (F.col("id") % 4 * 0.25).alias("part"),
    )
    fitted = likelihood.fit_logistic(df, ["x", "none"], "y", ["id"])
    assert (fitted.status, fitted.left_out) == ("fitted", ("none",))
    assert likelihood.fit_logistic(df, ["none"], "y", ["id"]).status == "refused"
    assert "not whole" in likelihood.fit_logistic(df, ["x"], "part", ["id"]).reason


def test_the_certificate_tells_the_optimum_from_other_fits(spark):
    df = spark.range(600).select(
        "id",
        F.when(F.col("id") % 11 != 0, (F.col("id") % 2) * 900.0 + F.rand(7) * 3000).alias("x"),
        F.when(F.col("id") % 13 != 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("c"),
        (F.col("id") % 2).alias("y"),
    )
    fitted = likelihood.fit_logistic(df, ["x", "c"], "y", ["id"])
    rows = {r["feature"]: r for r in fitted.certificate.collect()}
    assert set(rows) == {"(intercept)", "c=c0", "c=c1", "c=c2", "x"}
    assert max(abs(r["gradient"]) for r in rows.values()) < 1e-5
    assert rows["(intercept)"]["feature_sum"] == fitted.train_rows
    assert sum(rows[f"c=c{i}"]["feature_sum"] for i in range(3)) == fitted.train_rows

    # A fit that was stopped after one step does not pass.
    train = df.select("id", F.col("y").cast("int").alias("label"), F.coalesce("x", F.lit(0.0)).alias("x"))
    pipeline = likelihood.logistic_stages([], ["x"], 600)
    pipeline.getStages()[-1].setMaxIter(1)
    early = likelihood.optimality_certificate(pipeline.fit(train), train, [], ["x"])
    assert max(abs(r["gradient"]) for r in early.collect()) > 1e-3


def test_coefficients_equal_newtons_method(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -2.0])))).astype(int)
    df = spark.createDataFrame([(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id int, a double, b double, y int")
    fitted = likelihood.fit_logistic(df, ["a", "b"], "y", ["id"])
    test = {r["id"] for r in fitted.scored.collect()}
    rest = np.array([i not in test for i in range(500)])
    design, target, w = np.column_stack([np.ones(rest.sum()), x[rest]]), y[rest], np.zeros(3)
    penalty = np.diag([0.0, 1.0, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ w))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + penalty
        w -= np.linalg.solve(hessian, design.T @ (p - target) + penalty @ w)
    got = {r["feature"]: r["coefficient"] for r in fitted.certificate.collect()}
    assert [got["(intercept)"], got["a"], got["b"]] == pytest.approx(w.tolist(), abs=1e-5)


def test_split_follows_md5(spark):
    df = spark.range(50).select(F.when(F.col("id") != 9, F.col("id")).alias("id"), F.lit(1).alias("y"))
    unit = lambda k: int(hashlib.md5(f"42:{'' if k is None else k}".encode()).hexdigest()[:13], 16)
    want = sorted((r["id"] for r in df.collect()), key=unit)[:10]
    got = [r["id"] for r in likelihood.stratified_split(df, "y", ["id"], 0.2).where("is_test").collect()]
    assert set(got) == set(want) and len(got) == 10
