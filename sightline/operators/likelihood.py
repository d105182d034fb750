"""Observed rates and a logistic likelihood model with its report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import fixed_values as fv
from sightline.functions.quantiles import exact_median, ranked_values
from sightline.functions.scalars import as_number, ident, number_sql, quoted, sql_text
from sightline.operators.features import (
    create_features,
    detect_features,
    detect_group,
    detect_target,
    is_category,
)
from sightline.operators.profile import largest_dataset, rows_sql, union_all
from sightline.operators.roles import column_roles
from sightline.session import shared_folder

#: Hexadecimal digits of the hash that splits rows; 52 bits are exact in a double.
HASH_DIGITS = 13


def group_rates(
    df: DataFrame, group: str, target: str, min_rows: int = fv.MIN_GROUP_ROWS
) -> DataFrame:
    """Mean, count and sum of the target per group, highest rate first."""
    rows = df.select(quoted(group).alias(group), as_number(df, target).alias("_y")).dropna()
    return (
        rows.groupBy(group)
        .agg(F.avg("_y").alias("mean"), F.count("*").alias("count"), F.sum("_y").alias("sum"))
        .withColumn("percent_rate", F.col("mean") * 100)
        .where(F.col("count") >= min_rows)
        .orderBy(F.desc("percent_rate"), group)
    )


def rate_gap(rates: DataFrame, group: str) -> DataFrame:
    """Top and bottom group and their distance; no row for fewer than two groups."""
    top = F.min(F.struct((-F.col("percent_rate")).alias("rate"), F.col(group).alias("g")))
    # The last row of the ordered table: lowest rate, last name.
    bottom = F.max(F.struct((-F.col("percent_rate")).alias("rate"), F.col(group).alias("g")))
    return (
        rates.agg(F.count("*").alias("_n"), top.alias("_top"), bottom.alias("_low"))
        .where(F.col("_n") >= 2)
        .select(
            F.col("_top.g").alias("top_group"),
            (-F.col("_top.rate")).alias("top_rate"),
            F.col("_low.g").alias("bottom_group"),
            (-F.col("_low.rate")).alias("bottom_rate"),
            (F.col("_low.rate") - F.col("_top.rate")).alias("difference_points"),
        )
    )


# ---------------------------------------------------------------- imputing


def impute_values(
    df: DataFrame, categories: Sequence[str], numbers: Sequence[str]
) -> DataFrame:
    """Fill values per column: most frequent category, exact median of numbers."""
    parts = []
    if categories:
        rows = [
            {"column": sql_text(c), "value": f"CAST({ident(c)} AS STRING)"} for c in categories
        ]
        counts = (
            df.selectExpr(rows_sql(rows))
            .where(F.col("value").isNotNull())
            .groupBy("column", "value")
            .agg(F.count("*").alias("n"))
        )
        best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value")))
        parts.append(
            counts.groupBy("column")
            .agg(best.alias("best"))
            .select("column", F.col("best.value").alias("text_fill"))
        )
    if numbers:
        rows = [{"column": sql_text(c), "x": number_sql(df, c)} for c in numbers]
        parts.append(
            exact_median(df.selectExpr(rows_sql(rows)), "x", ["column"]).withColumnRenamed(
                "median", "number_fill"
            )
        )
    spark = df.sparkSession
    empty = spark.createDataFrame([], "column string, text_fill string, number_fill double")
    return union_all([empty, *parts])


def fill_missing(
    df: DataFrame, fills: DataFrame, categories: Sequence[str], numbers: Sequence[str]
) -> DataFrame:
    """Apply fill values; they are collected, one per feature."""
    values = {r["column"]: r for r in fills.collect()}
    new = {}
    for c in categories:
        fill = values[c]["text_fill"] if c in values else None
        new[c] = F.coalesce(quoted(c).cast("string"), F.lit(fill))
    for c in numbers:
        fill = values[c]["number_fill"] if c in values else None
        new[c] = F.coalesce(as_number(df, c), F.lit(fill))
    return df.withColumns(new)


# ------------------------------------------------------------------- split


def stratified_split(
    df: DataFrame, target: str, key: Sequence[str], share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: the given share of every class, chosen by the MD5 of seed and key.

    Any engine can repeat the choice: the first 13 hexadecimal digits of ``md5('seed:key:...')``, a missing
    key being empty text, and of every class the rows with the smallest of these. The cut per class is an order statistic of the hash, found without sorting a
    class in one task; classes are few, so the cuts are broadcast.
    """
    parts = [F.lit(str(seed)), *[F.coalesce(quoted(k).cast("string"), F.lit("")) for k in key]]
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, HASH_DIGITS), 16, 10).cast("double")
    marked = df.withColumn("_unit", unit)
    wanted = F.rint(F.col("_size") * F.lit(float(share))).cast("bigint")
    ranks = F.filter(
        F.array(F.struct((wanted - 1).alias("rank"))), lambda w: w["rank"] >= 0
    )
    cuts = ranked_values(marked, "_unit", ranks, [target]).select(
        F.col(target).alias("_class"), F.col("value").alias("_cut")
    )
    joined = marked.join(cuts, F.col(target) == F.col("_class"), "left")
    return joined.withColumn(
        "is_test", F.coalesce(F.col("_unit") <= F.col("_cut"), F.lit(False))
    ).drop("_unit", "_class", "_cut")


# ------------------------------------------------------------------- model


@dataclass(frozen=True)
class FittedModel:
    """``status`` is 'fitted' or 'refused' with a ``reason``.

    ``left_out`` names the features without any value in the training rows. ``certificate`` proves the fit
    (see ``optimality_certificate``).
    """

    status: str
    reason: str | None = None
    report: DataFrame | None = None
    scored: DataFrame | None = None
    sample: DataFrame | None = None
    train_rows: int = 0
    test_rows: int = 0
    left_out: tuple[str, ...] = ()
    certificate: DataFrame | None = None


def _written(df: DataFrame, name: str) -> DataFrame:
    """The table, written once to the shared folder, so that no later use repeats the work."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def logistic_stages(categories: Sequence[str], numbers: Sequence[str], n_train: int) -> Pipeline:
    """One-hot categories and plain numbers into an L2 logistic regression.

    The penalty is that of a unit inverse strength on the summed loss.
    """
    indexed = [f"_i_{c}" for c in categories]
    encoded = [f"_v_{c}" for c in categories]
    stages = []
    if categories:
        stages.append(
            StringIndexer(
                inputCols=list(categories), outputCols=indexed, handleInvalid="keep",
                stringOrderType="alphabetAsc",
            )
        )
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True))
    stages.append(
        VectorAssembler(inputCols=[*encoded, *numbers], outputCol="_features", handleInvalid="error")
    )
    stages.append(
        LogisticRegression(
            featuresCol="_features", labelCol="label", regParam=1.0 / n_train,
            elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-12,
        )
    )
    return Pipeline(stages=stages)


def feature_names(model: PipelineModel, categories: Sequence[str], numbers: Sequence[str]) -> list[str]:
    """Names of the coefficients in their order: ``column=level`` for categories."""
    levels = model.stages[0].labelsArray if categories else []
    return [f"{c}={level}" for c, known in zip(categories, levels) for level in known] + list(numbers)


def optimality_certificate(
    model: PipelineModel, train: DataFrame, categories: Sequence[str], numbers: Sequence[str]
) -> DataFrame:
    """One row per coefficient that tells whether the fit is the optimum, from one pass over the training rows.

    The penalised loss is strictly convex, so a fit is the optimum exactly where its gradient is zero: for a
    feature, the sum of (p - y) x plus the coefficient (a penalty of unit strength); for the intercept, the sum
    of (p - y), which is free of penalty, so that the mean of p equals that of y. ``gradient`` is this sum
    divided by the sum of absolute values of x, which makes it free of units. ``feature_sum`` is the sum of x:
    it shows, apart from the fit, which rows were split off, how gaps were filled and levels coded.
    """
    names = feature_names(model, categories, numbers)
    p = vector_to_array("probability")[1]
    x = F.col("_features")
    sums = (
        model.transform(train)
        .agg(
            Summarizer.metrics("sum", "normL1").summary(x).alias("plain"),
            Summarizer.metrics("sum").summary(x, p).alias("said"),
            Summarizer.metrics("sum").summary(x, F.col("label").cast("double")).alias("was"),
            F.count("*").alias("rows"),
            F.sum(p - F.col("label")).alias("rest"),
        )
        # One value per coefficient.
        .first()
    )
    fitted = model.stages[-1]
    rows = [("(intercept)", float(fitted.intercept), float(sums["rows"]), sums["rest"] / sums["rows"])]
    for i, name in enumerate(names):
        w, size = float(fitted.coefficients[i]), float(sums["plain"]["normL1"][i])
        gradient = float(sums["said"]["sum"][i]) - float(sums["was"]["sum"][i]) + w
        rows.append((name, w, float(sums["plain"]["sum"][i]), gradient / max(size, 1.0)))
    return train.sparkSession.createDataFrame(
        rows, "feature string, coefficient double, feature_sum double, gradient double"
    )


def fit_logistic(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    key: Sequence[str],
    seed: int = 42,
    test_share: float = 0.2,
) -> FittedModel:
    """Split, impute on the training rows, fit, and score the test rows."""
    if not features:
        return FittedModel("refused", fv.NO_FEATURES)
    working = df.select(
        *dict.fromkeys([*key, *features]), as_number(df, target).alias("label")
    ).where(F.col("label").isNotNull())
    facts = working.agg(
        F.count("*").alias("rows"), F.min("label").alias("low"), F.max("label").alias("high"),
        F.count_if(F.col("label") != F.floor("label")).alias("fractions"),
    ).first()
    if facts["rows"] == 0:
        return FittedModel("refused", fv.NO_TARGET_VALUES)
    if facts["fractions"]:
        return FittedModel("refused", "The target holds numbers that are not whole, so it has no classes.")
    working = working.withColumn("label", F.col("label").cast("int"))
    if facts["low"] == facts["high"]:
        return FittedModel("refused", fv.ONE_CLASS)
    categories = [c for c in features if is_category(df, c)]
    numbers = [c for c in features if c not in categories]
    split = _written(stratified_split(working, "label", key, test_share, seed), "split")
    # One row per feature.
    found = impute_values(split.where(~F.col("is_test")), categories, numbers).collect()
    fills = df.sparkSession.createDataFrame(found, "column string, text_fill string, number_fill double")
    known = {r["column"] for r in found if r["text_fill"] is not None or r["number_fill"] is not None}
    left_out = tuple(c for c in features if c not in known)
    categories, numbers = ([c for c in x if c in known] for x in (categories, numbers))
    if not known:
        return FittedModel("refused", "No feature has a value in the training rows.", left_out=left_out)
    filled = fill_missing(split, fills, categories, numbers)
    train, test = filled.where(~F.col("is_test")), filled.where("is_test")
    counted = {r["is_test"]: r["count"] for r in split.groupBy("is_test").count().collect()}
    n_train, n_test = counted.get(False, 0), counted.get(True, 0)
    model = logistic_stages(categories, numbers, n_train).fit(train)
    scored = model.transform(test).select(
        *key,
        *[c for c in features if c not in key],
        F.col("label").alias("actual"),
        vector_to_array("probability")[1].alias("predicted_probability"),
        F.col("prediction").cast("int").alias("predicted_class"),
    )
    scored = _written(scored, "scored")
    return FittedModel(
        "fitted",
        None,
        classification_report(scored, "actual", "predicted_class"),
        scored,
        scored.orderBy(*key).limit(20),
        n_train,
        n_test,
        left_out,
        optimality_certificate(model, train, categories, numbers),
    )


def classification_report(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy and two averages."""
    confusion = scored.groupBy(F.col(actual).alias("y"), F.col(predicted).alias("p")).agg(
        F.count("*").alias("n")
    )
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("y").alias("class"), hit.alias("hits"), zero.alias("said"), F.col("n").alias("support")
        ),
        F.struct(
            F.col("p").alias("class"), zero.alias("hits"), F.col("n").alias("said"), zero.alias("support")
        ),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    classes = (
        confusion.select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("hits", "said", "support")])
        .withColumn("precision", ratio(F.col("hits"), F.col("said")))
        .withColumn("recall", ratio(F.col("hits"), F.col("support")))
        .withColumn(
            "f1_score",
            ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
    )
    measures = ("precision", "recall", "f1_score")
    total = F.sum("support")
    overall = classes.agg(
        total.alias("support"),
        (F.sum("hits") / total).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}") for m in measures],
    )
    summary = overall.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("accuracy").alias("label"),
                    *[F.col("accuracy").alias(m) for m in measures],
                    "support",
                ),
                *[
                    F.struct(
                        F.lit(f"{kind} avg").alias("label"),
                        *[F.col(f"{kind}_{m}").alias(m) for m in measures],
                        F.col("support"),
                    )
                    for kind in ("macro", "weighted")
                ],
            )
        )
    )
    per_class = classes.select(F.col("class").cast("string").alias("label"), *measures, "support")
    return per_class.unionByName(summary)


# ---------------------------------------------------------------- workflow


def model_likelihood(
    datasets: dict[str, DataFrame],
    keys: dict[str, Sequence[str]],
    related: dict[str, Sequence[str]] | None = None,
    seed: int = 42,
) -> dict:
    """Choose the largest dataset, target, features and group; rates and model.

    Returns the choices, ``group_rates`` and the ``FittedModel`` (or a refusal).
    """
    if not datasets:
        return {"model": FittedModel("refused", fv.NO_DATASETS)}
    name = largest_dataset(datasets).first()["dataset"]
    df = create_features(datasets[name])
    roles = column_roles(df, name)
    target = detect_target(roles)
    if target is None:
        return {
            "dataset": name,
            "model": FittedModel("refused", fv.NO_TARGET),
        }
    features = detect_features(roles, target, (related or {}).get(name, ()))
    group = detect_group(roles, target)
    df = df.withColumn(target, as_number(df, target))
    return {
        "dataset": name,
        "target": target,
        "features": features,
        "group": group,
        "group_rates": group_rates(df, group, target) if group else None,
        "model": fit_logistic(df, features, target, keys[name], seed),
    }


def model_facts(spark: SparkSession, out: dict) -> DataFrame:
    """One row on a run of ``model_likelihood``: choices, rows, accuracy, the best and the worst group."""
    model, group = out["model"], out.get("group")
    gap = rate_gap(out["group_rates"], group).first() if out.get("group_rates") is not None else None
    score = model.report.where("label = 'accuracy'").first() if model.report is not None else None
    row = (
        out.get("dataset"), out.get("target"), ",".join(out.get("features", ())), group,
        model.status, model.reason, model.train_rows, model.test_rows, score and score["f1_score"],
        *([gap["top_group"], gap["bottom_group"], gap["difference_points"]] if gap else [None] * 3),
    )
    return spark.createDataFrame(
        [row],
        "dataset string, target string, features string, `group` string, status string, reason string, "
        "train_rows bigint, test_rows bigint, accuracy double, top_group string, bottom_group string, "
        "difference_points double",
    )
