"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline import fixed_values as fv

NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER_PATTERN = r"^[+-]?\d+$"


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric_type(dtype: T.DataType) -> bool:
    """Numbers only; booleans are not numeric here."""
    return isinstance(dtype, T.NumericType)


def is_text_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_temporal_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_nested_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    """A column by its literal name, also when the name holds dots."""
    return F.col(ident(name))


def sql_text(value: str) -> str:
    """A string literal."""
    return "'" + "".join(
        c if c.isalnum() or c in " _-.,:;()[]{}<>/|+*=!?#%&@~^$" else f"\\u{ord(c):04x}"
        for c in value
    ) + "'"


def round_even(value: Column, digits: int) -> Column:
    """Round half to even by scaling, the rounding of array libraries; never -0.0."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


# The per-column rules below are SQL texts, because wide aggregates use them for
# every column of a table; the functions next to them give the same as Columns.


def missing_sql(df: DataFrame, name: str) -> str:
    value = ident(name)
    if isinstance(field_type(df, name), (T.DoubleType, T.FloatType)):
        return f"({value} IS NULL OR isnan({value}))"
    return f"({value} IS NULL)"


def is_missing(df: DataFrame, name: str) -> Column:
    return F.expr(missing_sql(df, name))


def strip_sql(value: str) -> str:
    return f"btrim({value}, {sql_text(fv.WHITESPACE)})"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(fv.WHITESPACE))


def number_sql(df: DataFrame, name: str) -> str:
    value, dtype = ident(name), field_type(df, name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return f"nanvl(CAST({value} AS DOUBLE), CAST(NULL AS DOUBLE))"
    if is_numeric_type(dtype) or isinstance(dtype, T.BooleanType):
        return f"CAST({value} AS DOUBLE)"
    if is_text_type(dtype):
        # The pattern keeps out spellings the cast would accept, such as '5d'.
        text = strip_sql(value)
        return f"CASE WHEN {text} RLIKE r'{NUMBER_PATTERN}' THEN try_cast({text} AS DOUBLE) END"
    return "CAST(NULL AS DOUBLE)"


def as_number(df: DataFrame, name: str) -> Column:
    """Numeric coercion: what is not a number becomes null, NaN included."""
    return F.expr(number_sql(df, name))


def as_flag(df: DataFrame, name: str) -> Column:
    """Numeric coercion, missing as 0, truncated to int."""
    return F.coalesce(as_number(df, name), F.lit(0.0)).cast("int")


def as_key_text(df: DataFrame, name: str) -> Column:
    """Key as text without a trailing '.0'; never in scientific notation."""
    value, dtype = quoted(name), field_type(df, name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        number = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
        whole = number.try_cast("decimal(38,0)")
        return F.when(whole.cast("double") == number, whole.cast("string")).otherwise(
            number.cast("string")
        )
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def as_number_key(df: DataFrame, name: str) -> Column:
    """Numeric key whose integers stay exact: BIGINT, or DECIMAL(38, 9) of other types.

    What is not a number, or needs more than 29 digits, becomes null; fractions count to nine places.
    """
    value, dtype = quoted(name), field_type(df, name)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return value.cast("bigint")
    if isinstance(dtype, T.DecimalType):
        return value.try_cast("decimal(38,9)")
    if is_text_type(dtype):
        number = strip(value).try_cast("decimal(38,9)")
        return F.when(as_number(df, name).isNotNull(), number)
    return as_number(df, name).try_cast("decimal(38,9)")


def clean_key(df: DataFrame, name: str, sentinel: int = -1) -> Column:
    """Numeric key with the sentinel turned into null."""
    number = as_number_key(df, name)
    return F.when(number != F.lit(sentinel), number)


def timestamp_sql(
    df: DataFrame, name: str, formats: list[tuple[str, str]] | None = None
) -> str:
    value, dtype = ident(name), field_type(df, name)
    if is_temporal_type(dtype):
        return f"CAST({value} AS TIMESTAMP_NTZ)"
    if is_numeric_type(dtype):
        # A bare number counts nanoseconds since 1970.
        micros = f"try_cast({number_sql(df, name)} / 1000 AS BIGINT)"
        return f"CAST(timestamp_micros({micros}) AS TIMESTAMP_NTZ)"
    text = strip_sql(f"CAST({value} AS STRING)")
    tries = " ".join(
        f"WHEN {text} RLIKE r'{shape}' THEN try_to_timestamp({text}, {sql_text(spelling)})"
        for shape, spelling in formats or fv.DATE_FORMATS
    )
    # Only text that starts like a date is tried at all.
    likely = f"{text} RLIKE r'^(\\d{{1,4}}[-/ ]|[A-Z][a-z]{{2}} \\d)'"
    return f"CAST(CASE WHEN {likely} THEN CASE {tries} END END AS TIMESTAMP_NTZ)"


def as_timestamp(
    df: DataFrame, name: str, formats: list[tuple[str, str]] | None = None
) -> Column:
    """Timestamp of a temporal or text column; unparsable text becomes null.

    A failed parse is costly, so each format only sees text of its shape.
    """
    return F.expr(timestamp_sql(df, name, formats))


def day_number(
    df: DataFrame, name: str, formats: list[tuple[str, str]] | None = None
) -> Column:
    return F.unix_date(as_timestamp(df, name, formats).cast("date")).cast("double")


def domain_key(value: Column) -> Column:
    """Lower case with underscores: the spelling that groups equal domains."""
    return F.lower(F.replace(strip(value), F.lit(" "), F.lit("_")))


def title_label(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def strength_label(abs_value: Column) -> Column:
    out = None
    for cutoff, label in fv.STRENGTH_LABELS:
        cond = abs_value >= F.lit(cutoff)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise("very weak")


def light_name(name: str, underscores: bool = False) -> str:
    name = str(name).strip().lower()
    return name.replace(" ", "_") if underscores else name


def strict_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", str(name).strip().lower()).strip("_")


def ln_factorial(n: Column) -> Column:
    """ln(n!) for whole n >= 0: a small table, then Stirling's series.

    Needs no table that grows with n; the series error at n = 20 is below 1e-14.
    """
    exact = F.array(*[F.lit(math.lgamma(k + 1.0)) for k in range(20)])
    x = F.greatest(n.cast("double"), F.lit(1.0))
    x2 = x * x
    series = (
        (x + 0.5) * F.ln(x) - x + F.lit(0.5 * math.log(2 * math.pi))
        + (F.lit(1 / 12.0) - (F.lit(1 / 360.0) - (F.lit(1 / 1260.0) - F.lit(1 / 1680.0) / x2) / x2) / x2) / x
    )
    return F.when(n < 20, F.get(exact, n.cast("int"))).otherwise(series)
