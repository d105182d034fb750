"""Result tables to and from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.sources.csv import path_exists


def save_csv(df: DataFrame, path: str) -> None:
    """Header and quotes doubled inside quotes; one file per partition."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def save_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A saved JSON table; a missing one is an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which CSV can hold."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
