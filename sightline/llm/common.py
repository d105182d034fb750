"""Shared helpers: column picking, written intermediate tables, word counting."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.session import shared_folder
from sightline.sources.tables import table

__all__ = ["WORD", "mixed", "parted", "pick", "positioned", "staged", "table", "word_count"]

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact spelling, whatever else the table holds.

    Columns whose names differ only in case, or repeat, do not make a name ambiguous: the first with
    the exact spelling counts.
    """
    places = [df.columns.index(name) for name in names]
    apart = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return apart.select(*[F.col(f"_c{i}").alias(name) for i, name in zip(places, names)])


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    Later steps then start from files that outlive any executor, and costly steps run once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The lower bits of monotonically_increasing_id count rows of a partition.
_ROW_BITS = 33


def positioned(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with ``position``, their place (from 0) in the global order; no task sees more than its range.

    The rows are written in order over range partitions; how many rows come before each partition is known
    from one count per partition. The order should be unique, else many equal rows share a partition.
    """
    ranged = rows.repartitionByRange(max(1, shuffle_tasks(rows.sparkSession)), *order).sortWithinPartitions(*order)
    written = staged(ranged.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", _ROW_BITS).cast("int")
    sizes = {r["part"]: r["n"] for r in written.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(sizes, default=0) + 1):  # as many as there are partitions
        before.append(total)
        total += sizes.get(p, 0)
    place = F.element_at(F.lit(before), part + 1) + F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return written.withColumn("position", place.cast("long")).drop("_place")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parted(rows: pa.Array | pa.RecordBatch, size: int = 256) -> Iterator[pa.Array | pa.RecordBatch]:
    """Consecutive parts of a batch or column: as Python objects, its values would take several times its room."""
    for start in range(0, len(rows), size):
        yield rows.slice(start, size)


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
