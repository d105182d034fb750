"""Column statistics, column roles and candidate pairs.

``column_stats`` is the only pass over the data; roles, exclusions and pairs are
expressions on its one-row-per-column result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline import fixed_values as fv
from sightline.functions.scalars import (
    light_name,
    missing_sql,
    number_sql,
    quoted,
    sql_text,
    timestamp_sql,
)
from sightline.operators.profile import (
    distinct_counts,
    kind_of,
    sketch_distinct_sql,
    sketch_sql,
    unfold,
    union_all,
)

# A sketch of this size errs by about 0.4 %; the bands are more than five times that.
SMALL_DISTINCT = 100
RATIO_BAND = 0.025


def _measures(df: DataFrame, sketch: bool) -> DataFrame:
    """One row per column from one pass: kind, rows, missing, distinct, beyond_binary, sampled, parsed.

    ``distinct`` is the estimate of a sketch, or with ``sketch`` the sketch itself.
    """
    kinds = {c: kind_of(df, c) for c in df.columns}
    texts = [
        c for c in df.columns
        if kinds[c] == "text" and not any(t in light_name(c) for t in fv.TIME_NAME_TOKENS)
    ]
    aggs, fields = ["count(*) AS rows"], {}
    for i, c in enumerate(df.columns):
        aggs.append(f"count_if({missing_sql(df, c)}) AS m{i}")
        distinct, other, parsed = "CAST(NULL AS BINARY)" if sketch else "0L", "0L", "0L"
        if kinds[c] != "nested":
            aggs.append(f"{(sketch_sql if sketch else sketch_distinct_sql)(df, c)} AS d{i}")
            distinct = f"d{i}"
        if kinds[c] == "number":
            aggs.append(f"count_if({number_sql(df, c)} NOT IN (0D, 1D)) AS o{i}")
            other = f"o{i}"
        if c in texts:
            aggs.append(f"count({timestamp_sql(df, c)}) AS t{i}")
            parsed = f"t{i}"
        fields[c] = {
            "position": str(i),
            "kind": sql_text(kinds[c]),
            "rows": "rows",
            "missing": f"m{i}",
            "distinct": distinct,
            "beyond_binary": other,
            "sampled": f"rows - m{i}",
            "parsed": parsed,
        }
    return unfold(df.agg(*[F.expr(a) for a in aggs]), fields, "column")


def column_stats(
    df: DataFrame,
    dataset: str = "data",
    exact_distinct: bool = False,
) -> DataFrame:
    """One row per column: kind, rows, missing, distinct, 0/1 test, date share.

    Distinct counts are sketched in the same pass; ``distinct_estimate`` holds the sketch's figure.
    ``exact_distinct`` replaces ``distinct`` by exact counts for every column; otherwise
    ``settle_distinct`` does so only for columns whose estimate lies near a threshold.
    The date share of a text column is taken over all its values.
    """
    stats = _measures(df, False)
    stats = stats.withColumn("distinct_estimate", F.col("distinct"))
    if exact_distinct:
        flat = [c for c in df.columns if kind_of(df, c) != "nested"]
        stats = (
            stats.drop("distinct")
            .join(distinct_counts(df, flat), "column", "left")
            .withColumn("distinct", F.coalesce("distinct_count", F.lit(0)))
            .drop("distinct_count")
        )
    return _as_stats(stats.withColumn("dataset", F.lit(dataset)), exact_distinct)


def _as_stats(stats: DataFrame, exact_distinct: bool) -> DataFrame:
    return stats.select(
        "dataset",
        "column", "position", "kind", "rows", "missing",
        (F.col("rows") - F.col("missing")).alias("non_missing"),
        "distinct", "beyond_binary", "sampled", "parsed", "distinct_estimate",
        F.lit(exact_distinct).alias("distinct_is_exact"),
    )


def column_sketches(df: DataFrame, dataset: str = "data") -> DataFrame:
    """What a file adds to a catalogue, one row per column: counts and a sketch of its values.

    Keep the rows of every file as a table; ``stats_of_sketches`` merges any of them, so that a new file
    costs its own scan only. A sketch has at most 64 KB whatever the file's size.
    """
    return _measures(df, True).withColumnRenamed("distinct", "sketch").select(F.lit(dataset).alias("dataset"), "*")


def stats_of_sketches(sketches: DataFrame) -> DataFrame:
    """``column_stats`` of datasets whose files were sketched one by one; distinct counts are estimates.

    A column's kind must be the same in all files of a dataset, else it counts as text. Columns stand in
    the order of their first place in any file; a file without a column counts as missing there.
    """
    merged = sketches.groupBy("dataset", "column").agg(
        F.min("position").alias("position"),
        F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("text").alias("kind"),
        *[F.sum(c).alias(c) for c in ("rows", "missing", "beyond_binary", "sampled", "parsed")],
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).cast("bigint").alias("distinct"),
    )
    # Every file gives its rows with each of its columns; the fullest column has the rows of all files.
    whole = F.max("rows").over(Window.partitionBy("dataset"))
    merged = merged.withColumn("missing", F.col("missing") + whole - F.col("rows")).withColumn("rows", whole)
    return _as_stats(merged.withColumn("distinct_estimate", F.col("distinct")), False)


def merged_catalog(sketches: DataFrame, unique_ratio_rule: str = "all") -> DataFrame:
    """Roles and usability of every column from the sketches of its files, without reading the files."""
    return with_roles(stats_of_sketches(sketches), unique_ratio_rule)


def near_threshold() -> Column:
    """Whether an estimated distinct count could fall on either side of a rule."""
    ratio = F.col("distinct") / F.greatest("non_missing", F.lit(1))
    return (F.col("distinct") <= SMALL_DISTINCT) | ratio.between(
        fv.IDENTIFIER_RATIO - RATIO_BAND, fv.IDENTIFIER_RATIO + RATIO_BAND
    )


def settle_distinct(frames: dict[str, DataFrame], stats: DataFrame) -> DataFrame:
    """Exact distinct counts for the columns where the estimate cannot decide.

    Keys (ratio near 1) and free text are decided by the sketch and are never
    shuffled; columns with few values collapse before the shuffle. All datasets
    are counted in one job.
    """
    unsure: dict[str, list[str]] = {}
    for r in stats.where(near_threshold() & (F.col("kind") != "nested")).collect():
        unsure.setdefault(r["dataset"], []).append(r["column"])
    if not unsure:
        return stats
    exact = as_local_table(
        union_all(
            [
                distinct_counts(frames[name], columns).select(F.lit(name).alias("dataset"), "*")
                for name, columns in unsure.items()
            ]
        )
    )
    joined = stats.join(exact, ["dataset", "column"], "left")
    known = F.col("distinct_count").isNotNull()
    return joined.select(
        *[
            F.coalesce("distinct_count", c).alias(c)
            if c == "distinct"
            else known.alias(c)
            if c == "distinct_is_exact"
            else F.col(c)
            for c in stats.columns
        ]
    )


def as_local_table(small: DataFrame) -> DataFrame:
    """A table that is collected once, so that using it again does not rescan data.

    Only for metadata: one row per column, or a top-k report.
    """
    return small.sparkSession.createDataFrame(small.toArrow(), small.schema)


# ------------------------------------------------------------------- roles


def _name() -> Column:
    return F.lower(F.trim("column"))


def identifier_test(unique_ratio_rule: str = "all") -> Column:
    """Identifier by name or because nearly every value is different.

    ``unique_ratio_rule='non_float'`` keeps nearly unique measures comparable.
    """
    name = _name()
    by_name = (name == "id") | name.endswith("_id")
    for token in ("identifier", "record_id", "person_id", "patient_id"):
        by_name = by_name | name.contains(token)
    ratio = F.col("distinct") / F.greatest("non_missing", F.lit(1))
    by_ratio = (
        (F.col("non_missing") > 0)
        & (ratio > fv.IDENTIFIER_RATIO)
        & (F.col("distinct") > fv.IDENTIFIER_DISTINCT)
    )
    if unique_ratio_rule == "non_float":
        by_ratio = by_ratio & (F.col("kind") != "number")
    return by_name | by_ratio


def binary_test() -> Column:
    return (F.col("non_missing") > 0) & (
        ((F.col("kind") == "number") & (F.col("beyond_binary") == 0)) | (F.col("kind") == "boolean")
    )


def text_test() -> Column:
    return ~F.col("kind").isin("number", "boolean") & (F.col("distinct") > fv.TEXT_DISTINCT)


def time_test() -> Column:
    name = _name()
    by_name = F.lit(False)
    for token in fv.TIME_NAME_TOKENS:
        by_name = by_name | name.contains(token)
    enough = F.col("parsed") >= F.greatest(
        F.lit(fv.TIME_PARSED_ROWS), F.floor(F.col("sampled") * fv.TIME_PARSED_SHARE)
    )
    by_value = (F.col("non_missing") > 0) & (
        (F.col("kind") == "time") | ((F.col("kind") == "text") & enough)
    )
    return by_name | by_value


def with_roles(stats: DataFrame, unique_ratio_rule: str = "all") -> DataFrame:
    """Add ``role``, ``missing_percent``, ``usable`` and ``exclusion_reason``."""
    number = F.col("kind").isin("number", "boolean")
    role = (
        F.when(identifier_test(unique_ratio_rule), "identifier")
        .when(time_test() & _name().contains("year"), "year_like")
        .when(time_test(), "time_like")
        .when(binary_test(), "binary")
        .when(number & (F.col("distinct") <= fv.MAX_DISCRETE), "numeric_discrete")
        .when(number, "numeric_continuous")
        .when(text_test(), "text")
        .when(F.col("distinct") <= fv.MAX_CATEGORIES, "categorical")
        .otherwise("text")
    )
    percent = F.coalesce(F.try_divide(F.col("missing"), F.col("rows")) * 100, F.lit(100.0))
    reason = (
        F.when(F.col("missing_percent") > fv.MAX_MISSING_PERCENT, "too_much_missingness")
        .when(F.col("distinct") <= 1, "no_variation")
        .when(F.col("role").isin("identifier", "text"), F.col("role"))
    )
    return (
        stats.withColumn("role", role)
        .withColumn("missing_percent", percent)
        .withColumn("exclusion_reason", reason)
        .withColumn("usable", F.col("exclusion_reason").isNull())
    )


def column_roles(
    df: DataFrame,
    dataset: str = "data",
    exact_distinct: bool = False,
    unique_ratio_rule: str = "all",
) -> DataFrame:
    """Statistics, role and usability of every column."""
    return catalog_roles({dataset: df}, exact_distinct, unique_ratio_rule)


def catalog_roles(
    datasets: dict[str, DataFrame],
    exact_distinct: bool = False,
    unique_ratio_rule: str = "all",
) -> DataFrame:
    """``column_roles`` of several datasets, whose passes run side by side in one job.

    The statistics, one row per column, are collected; the result is a local
    table that roles, pairs and catalogues read as often as they like.
    """
    stats = as_local_table(
        union_all(
            [
                column_stats(df, name, exact_distinct)
                for name, df in datasets.items()
            ]
        )
    )
    if not exact_distinct:
        stats = settle_distinct(datasets, stats)
    return as_local_table(with_roles(stats, unique_ratio_rule))


# ------------------------------------------------------------------- pairs


def candidate_pairs(roles: DataFrame) -> DataFrame:
    """Typed pairs of usable columns of one dataset: method, column_a, column_b.

    The input has one row per column. Categorical, binary and time columns are
    placed first, numeric ones second.
    """
    usable = roles.where("usable")
    a = usable.select(
        "dataset", F.col("column").alias("a"), F.col("position").alias("pa"), F.col("role").alias("ra")
    )
    b = usable.select(
        "dataset", F.col("column").alias("b"), F.col("position").alias("pb"), F.col("role").alias("rb")
    )
    numeric, time = ["numeric_continuous", "numeric_discrete"], ["year_like", "time_like"]
    num_b = F.col("rb").isin(*numeric)
    method = (
        F.when(
            F.col("ra").isin(*numeric) & num_b & (F.col("pa") < F.col("pb")), "numeric_numeric"
        )
        .when((F.col("ra") == "categorical") & (F.col("rb") == "binary"), "categorical_binary")
        .when((F.col("ra") == "binary") & num_b, "binary_numeric")
        .when((F.col("ra") == "categorical") & num_b, "categorical_numeric")
        .when(F.col("ra").isin(*time) & num_b, "time_numeric")
    )
    return (
        a.join(b, "dataset")
        .withColumn("method", method)
        .where(F.col("method").isNotNull())
        .select("dataset", "method", F.col("a").alias("column_a"), F.col("b").alias("column_b"))
    )
