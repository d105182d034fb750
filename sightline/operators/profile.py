"""Profiles of datasets and columns, each from one aggregation pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.quantiles import exact_quantiles
from sightline.functions.scalars import (
    field_type,
    ident,
    is_missing,
    is_nested_type,
    is_numeric_type,
    is_temporal_type,
    is_text_type,
    missing_sql,
    number_sql,
    quoted,
    sql_text,
)

SKETCH_SIZE = 16


def rows_sql(rows: list[dict[str, str]]) -> str:
    """SQL that turns one row into one row per entry; values are SQL texts."""
    structs = ", ".join(
        "struct(" + ", ".join(f"{sql} AS {ident(name)}" for name, sql in row.items()) + ")"
        for row in rows
    )
    return f"inline(array({structs}))"


def unfold(one_row: DataFrame, measures: dict[str, dict[str, str]], key: str) -> DataFrame:
    """Turn one wide row into one row per entry: {entry: {field: SQL text}}."""
    return one_row.selectExpr(
        rows_sql([{key: sql_text(name), **fields} for name, fields in measures.items()])
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


# ------------------------------------------------------------ dataset level


def dataset_shape(datasets: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each dataset. Counts come from file footers where possible."""
    return union_all(
        [
            df.agg(F.count("*").alias("rows")).select(
                F.lit(name).alias("dataset"),
                "rows",
                F.lit(len(df.columns)).cast("bigint").alias("columns"),
            )
            for name, df in datasets.items()
        ]
    )


def largest_dataset(datasets: dict[str, DataFrame]) -> DataFrame:
    """The dataset with the most rows; ties go to the first name."""
    return dataset_shape(datasets).orderBy(F.desc("rows"), "dataset").limit(1)


def column_list(datasets: dict[str, DataFrame]) -> DataFrame:
    """Catalogue of names and types, read from the schemas alone."""
    spark = next(iter(datasets.values())).sparkSession
    rows = [
        (name, field.name, pos, field.dataType.simpleString(), is_numeric_type(field.dataType))
        for name, df in datasets.items()
        for pos, field in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(
        rows, "dataset string, column string, position int, dtype string, is_numeric boolean"
    )


def shared_columns(catalog: DataFrame) -> DataFrame:
    """Columns with the same name in two datasets, one row per dataset pair."""
    left = catalog.select(F.col("dataset").alias("dataset_a"), "column")
    right = catalog.select(F.col("dataset").alias("dataset_b"), "column")
    return (
        left.join(right, "column")
        .where(F.col("dataset_a") < F.col("dataset_b"))
        .groupBy("dataset_a", "dataset_b")
        .agg(F.sort_array(F.collect_set("column")).alias("shared_columns"))
        .withColumn("n_shared", F.size("shared_columns"))
    )


def row_signature(keys: Sequence[Column]) -> Column:
    """Two 64-bit hashes of a row."""
    return F.struct(F.xxhash64(*keys).alias("h1"), F.xxhash64(F.lit(1), *keys, F.lit(2)).alias("h2"))


def duplicate_rows(df: DataFrame, signature: Callable[[Sequence[Column]], Column] = row_signature) -> DataFrame:
    """Rows beyond the first of each set of equal rows; nulls are equal.

    Signatures of 16 bytes are counted first, in part before the shuffle. Only rows whose signature
    repeats are compared in full, copies again counted before the shuffle, so different rows that share a
    signature are told apart and a table without repeats moves no row.
    """
    # Maps cannot be grouped; their sorted entries can.
    keys = [
        F.array_sort(F.map_entries(quoted(f.name))).alias(f"_k{i}")
        if f.dataType.typeName() == "map"
        else quoted(f.name).alias(f"_k{i}")
        for i, f in enumerate(df.schema.fields)
    ]
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*keys).withColumn("_signature", signature([F.col(n) for n in names]))
    counted = rows.groupBy("_signature").agg(F.count("*").alias("_n"))
    # Counts of copies, one row per different row of a repeated signature.
    groups = (
        rows.join(counted.where("_n > 1").select("_signature"), "_signature", "left_semi")
        .groupBy("_signature", *names).agg(F.count("*").alias("_copies"))
    )
    beyond = groups.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0))).scalar()
    return counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).withColumn("duplicate_rows", beyond)


def sample_rows(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order_by).limit(n)


# ------------------------------------------------------------- column level


def missing_values(df: DataFrame) -> DataFrame:
    """Missing count and percent per column; NaN counts as missing."""
    counts = df.agg(
        F.count("*").alias("rows"),
        *[
            F.expr(f"count_if({missing_sql(df, c)}) AS m{i}")
            for i, c in enumerate(df.columns)
        ],
    )
    return unfold(
        counts,
        {
            c: {
                "missing_count": f"m{i}",
                "missing_percent": f"coalesce(try_divide(m{i}, rows) * 100, 100D)",
            }
            for i, c in enumerate(df.columns)
        },
        "column",
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, standard deviation, minimum, exact quartiles and maximum.

    The moments come from one wide aggregate; the quartiles of all columns from
    one exact quantile run over (column, value) rows.
    """
    columns = list(columns or numeric_columns(df))
    numbers = df.selectExpr(*[f"{number_sql(df, c)} AS x{i}" for i, c in enumerate(columns)])
    kept = {"count": "count", "mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    moments = numbers.agg(
        *[
            F.expr(f"{fn}(x{i}) AS {name}{i}")
            for i in range(len(columns))
            for name, fn in kept.items()
        ]
    )
    basic = unfold(
        moments,
        {c: {name: f"{name}{i}" for name in kept} for i, c in enumerate(columns)},
        "column",
    )
    long = numbers.selectExpr(
        rows_sql([{"column": sql_text(c), "x": f"x{i}"} for i, c in enumerate(columns)])
    )
    quartiles = (
        exact_quantiles(long, "x", [0.25, 0.5, 0.75], ["column"])
        .groupBy("column")
        .agg(
            *[
                F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(name)
                for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
            ]
        )
    )
    return basic.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact distinct non-missing values per column.

    Values are grouped as (column, value) rows, so every column is spread over
    the cluster by its values and repeated values collapse before the shuffle.
    Whole numbers, other numbers and everything else are grouped apart, each in
    a type that hashes cheaply.
    """
    columns = list(columns or df.columns)
    forms: dict[str, list[str]] = {}
    for c in columns:
        forms.setdefault(_value_type(df, c), []).append(c)

    def one_type(type_name: str, names: list[str]) -> DataFrame:
        rows = [
            {
                "k": str(columns.index(c)),
                "value": f"CASE WHEN NOT {missing_sql(df, c)} THEN {_value_form(df, c, type_name)} END",
            }
            for c in names
        ]
        return (
            df.selectExpr(rows_sql(rows))
            .groupBy("k", "value")
            .agg(F.lit(1).alias("_one"))
            .groupBy("k")
            .agg(F.count("value").alias("distinct_count"))
        )

    labels = "CASE k " + " ".join(
        f"WHEN {i} THEN {sql_text(c)}" for i, c in enumerate(columns)
    ) + " END AS column"
    counted = union_all([one_type(t, names) for t, names in forms.items()])
    return counted.selectExpr(labels, "distinct_count")


def _value_type(df: DataFrame, name: str) -> str:
    kind = field_type(df, name).typeName()
    if kind in ("byte", "short", "integer", "long"):
        return "BIGINT"
    return "DOUBLE" if kind in ("float", "double") else "STRING"


def _value_form(df: DataFrame, name: str, type_name: str) -> str:
    dtype, value = field_type(df, name), ident(name)
    if is_nested_type(dtype) and dtype.typeName() != "binary":
        return f"to_json(struct({value}))"
    return f"CAST({value} AS {type_name})"


def sketch_sql(df: DataFrame, name: str) -> str:
    """A sketch of the different values, at most 64 KB; sketches of two tables can be merged."""
    value = f"CASE WHEN NOT {missing_sql(df, name)} THEN xxhash64({ident(name)}) END"
    return f"hll_sketch_agg({value}, {SKETCH_SIZE})"


def sketch_distinct_sql(df: DataFrame, name: str) -> str:
    """Estimated distinct values; the sketch is 64 KB per column and task."""
    return f"coalesce(hll_sketch_estimate({sketch_sql(df, name)}), 0)"


def value_counts(
    df: DataFrame,
    column: str,
    n: int = 10,
    count_missing: bool = True,
    max_distinct: int | None = None,
) -> DataFrame:
    """The most frequent values. Missing counts as the text 'nan' or not at all.

    With ``max_distinct`` a column with more distinct values gives no rows.
    """
    text = quoted(column).cast("string")
    missing = is_missing(df, column)
    if count_missing:
        values = df.select(F.when(missing, F.lit("nan")).otherwise(text).alias("value"))
    else:
        values = df.where(~missing).select(text.alias("value"))
    counts = values.groupBy("value").agg(F.count("*").alias("count"))
    if max_distinct is not None:
        distinct = counts.agg(F.count("*")).scalar()
        counts = counts.where(distinct <= max_distinct)
    return counts.orderBy(F.desc("count"), "value").limit(n)


def kind_of(df: DataFrame, name: str) -> str:
    dtype = field_type(df, name)
    if is_numeric_type(dtype):
        return "number"
    if dtype.typeName() == "boolean":
        return "boolean"
    if is_temporal_type(dtype):
        return "time"
    if is_text_type(dtype):
        return "text"
    return "nested"
