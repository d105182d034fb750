"""Feature engineering on one table, and the choice of target and features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import fixed_values as fv
from sightline.functions.quantiles import exact_median
from sightline.functions.scalars import (
    as_number,
    field_type,
    is_numeric_type,
    is_text_type,
    quoted,
    strip,
)

# These columns keep their words: "no" in them is a status, not a 0.
STATUS_COLUMNS = ("employment_status", "insurance_status")


def _word(name: str) -> Column:
    return F.lower(strip(quoted(name).cast("string")))


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text_type(f.dataType)]


@dataclass(frozen=True)
class FeaturePlan:
    """What one counting pass over the raw table decides."""

    boolean_like: list[str] = field(default_factory=list)
    mapped_targets: list[str] = field(default_factory=list)
    numeric_filled: list[str] = field(default_factory=list)


def plan_features(df: DataFrame, keep: Sequence[str] = STATUS_COLUMNS) -> FeaturePlan:
    """Count, in one pass, what decides which columns are converted or created."""
    texts = [c for c in _text_columns(df) if c not in keep]
    targets = [c for c in fv.TEXT_TARGETS if c in texts]
    numbers = [c for c in ("birth_year", "age", "income") if c in df.columns]
    words = fv.TRUE_WORDS + fv.FALSE_WORDS
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(texts):
        aggs += [
            F.count_if(_word(c).isin(words)).alias(f"b{i}"),
            F.count(quoted(c)).alias(f"n{i}"),
        ]
    for i, c in enumerate(targets):
        aggs.append(F.count_if(_word(c).isin(list(fv.TEXT_TARGET_VALUES))).alias(f"t{i}"))
    for i, c in enumerate(numbers):
        aggs.append(F.count(as_number(df, c)).alias(f"f{i}"))
    row = df.agg(*aggs).first()
    boolean = [
        c for i, c in enumerate(texts)
        if row[f"b{i}"] > 0 and row[f"b{i}"] >= fv.BOOLEAN_SHARE * row[f"n{i}"]
    ]
    mapped = [c for i, c in enumerate(targets) if row[f"t{i}"] > 0 and c not in boolean]
    filled = [c for i, c in enumerate(numbers) if row[f"f{i}"] > 0]
    return FeaturePlan(boolean, mapped, filled)


def boolean_value(name: str) -> Column:
    return F.when(_word(name).isin(fv.TRUE_WORDS), 1).when(_word(name).isin(fv.FALSE_WORDS), 0)


def convert_boolean_like(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Yes/no style text columns as 1/0; other words in them become null."""
    if columns is None:
        columns = plan_features(df).boolean_like
    return df.withColumns({c: boolean_value(c) for c in columns}) if columns else df


def age_group(age: Column) -> Column:
    """Age band, closed on the right; the first band also holds its lower edge."""
    edges, labels = fv.AGE_EDGES, fv.AGE_LABELS
    out = F.when((age >= edges[0]) & (age <= edges[1]), labels[0])
    for low, high, label in zip(edges[1:], edges[2:], labels[1:]):
        out = out.when((age > low) & (age <= high), label)
    return out


def status_flag(name: str, words: Sequence[str]) -> Column:
    return F.coalesce(_word(name).isin(list(words)), F.lit(False)).cast("int")


def add_ages(df: DataFrame, plan: FeaturePlan, reference_year: int = fv.REFERENCE_YEAR) -> DataFrame:
    if "birth_year" in df.columns:
        df = df.withColumn("birth_year", as_number(df, "birth_year"))
        if "birth_year" in plan.numeric_filled:
            df = df.withColumn("age", F.lit(float(reference_year)) - F.col("birth_year"))
    if "age" in df.columns:
        df = df.withColumn("age", as_number(df, "age"))
        if {"birth_year", "age"} & set(plan.numeric_filled):
            df = df.withColumn("age_group", age_group(F.col("age")))
    return df


def add_low_income(df: DataFrame, plan: FeaturePlan) -> DataFrame:
    """Whether income lies below the exact median; missing income is not low."""
    if "income" not in df.columns:
        return df
    df = df.withColumn("income", as_number(df, "income"))
    if "income" not in plan.numeric_filled:
        return df
    median = exact_median(df.select("income"), "income").scalar()
    return df.withColumn(
        "low_income", F.coalesce(F.col("income") < median, F.lit(False)).cast("int")
    )


def add_status_flags(df: DataFrame) -> DataFrame:
    if "employment_status" in df.columns and "unemployed" not in df.columns:
        df = df.withColumn("unemployed", status_flag("employment_status", fv.UNEMPLOYED_WORDS))
    if "insurance_status" in df.columns and "no_health_insurance" not in df.columns:
        df = df.withColumn(
            "no_health_insurance", status_flag("insurance_status", fv.UNINSURED_WORDS)
        )
    return df


def add_burden(
    df: DataFrame,
    indicators: Sequence[str] = tuple(fv.BURDEN_INDICATORS),
    cutoff: float = fv.BURDEN_CUTOFF,
) -> DataFrame:
    """Sum of the indicators that are present, and whether it reaches the cut-off."""
    present = [c for c in indicators if c in df.columns]
    if not present:
        return df
    words = {c: as_number(df, c) for c in present if not is_numeric_type(field_type(df, c))}
    if words:
        df = df.withColumns(words)
    score = F.lit(0.0)
    for c in present:
        score = score + F.coalesce(as_number(df, c), F.lit(0.0))
    return df.withColumn("social_determinant_score", score).withColumn(
        "high_social_determinant_burden", (F.col("social_determinant_score") >= cutoff).cast("int")
    )


def map_text_targets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Words for positive and negative outcomes as 1 and 0; other words are null."""
    for c in columns:
        out = None
        for word, value in fv.TEXT_TARGET_VALUES.items():
            cond = _word(c) == word
            out = F.when(cond, value) if out is None else out.when(cond, value)
        df = df.withColumn(c, out)
    return df


def create_features(df: DataFrame, reference_year: int = fv.REFERENCE_YEAR) -> DataFrame:
    """All derived columns that the table's columns allow. One counting pass, then lazy."""
    plan = plan_features(df)
    df = convert_boolean_like(df, plan.boolean_like)
    df = add_ages(df, plan, reference_year)
    df = add_low_income(df, plan)
    df = add_status_flags(df)
    df = add_burden(df)
    return map_text_targets(df, plan.mapped_targets)


# ------------------------------------------------------- choice of columns


def _collected(roles: DataFrame) -> list:
    return roles.orderBy("position").collect()


def detect_target(roles: DataFrame, names: Sequence[str] = tuple(fv.TARGET_NAMES)) -> str | None:
    """A known outcome name, else a two-valued 0/1 column, best keyword first."""
    rows = _collected(roles)
    present = [r["column"] for r in rows]
    for name in names:
        if name in present:
            return name
    binary = [
        r["column"] for r in rows
        if r["distinct"] == 2
        and (r["kind"] == "boolean" or (r["kind"] == "number" and r["beyond_binary"] == 0))
    ]
    for keyword in fv.TARGET_KEYWORDS:
        for name in binary:
            if keyword in name.lower():
                return name
    return binary[0] if binary else None


def detect_features(
    roles: DataFrame,
    target: str,
    related: Sequence[str] = (),
    limit: int | None = None,
) -> list[str]:
    """Columns of strong relationships, then usual names, else any simple column.

    Columns that are mostly missing, constant, identifiers or wide text drop out. All others
    are returned, or the first ``limit``.
    """
    rows = {r["column"]: r for r in _collected(roles)}
    chosen = [c for c in dict.fromkeys([*related, *fv.FEATURE_NAMES]) if c in rows and c != target]
    if not chosen:
        chosen = [
            c for c, r in rows.items()
            if c != target and (r["kind"] in ("number", "boolean") or r["distinct"] <= 15)
        ]

    def good(r) -> bool:
        name = r["column"].lower()
        named_id = name == "id" or name.endswith("_id") or "identifier" in name
        mostly_missing = r["rows"] == 0 or r["missing"] / r["rows"] >= 0.80
        wide_text = r["kind"] == "text" and r["distinct"] > 40
        return not (mostly_missing or r["distinct"] <= 1 or named_id or wide_text)

    return [c for c in chosen if good(rows[c])][:limit]


def detect_group(roles: DataFrame, target: str) -> str | None:
    """A usual group column with 2-20 values, else any text column with 2-15."""
    rows = _collected(roles)
    by_name = {r["column"]: r for r in rows}
    for name in fv.GROUP_NAMES:
        if name in by_name and name != target and 2 <= by_name[name]["distinct"] <= 20:
            return name
    for r in rows:
        if r["column"] != target and r["kind"] == "text" and 2 <= r["distinct"] <= 15:
            return r["column"]
    return None


def is_category(df: DataFrame, name: str) -> bool:
    dtype = field_type(df, name)
    return not (is_numeric_type(dtype) or dtype.typeName() == "boolean")
