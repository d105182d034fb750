"""Exact interpolated quantiles and order statistics without a big group.

The built-in exact ``percentile`` keeps every distinct value of a group in the
memory of one task. Here a group is narrowed down in three steps instead, each a
partial aggregation whose output is bounded or spread over the cluster:

1. count per *cell*: 1,024 cells for each power of two, in value order;
2. in the few cells that hold a wanted rank, count per distinct value, and sum
   those counts over 65,536 slices of the cell;
3. in the few slices that hold a wanted rank, order the distinct values.

A value that fills a third of all rows is one counted entry at every step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS_PER_BINADE = 1024
SLICES_PER_CELL = 65536
# log2 of any finite double lies strictly between -1075 and 1025.
LOWEST_LOG, HIGHEST_LOG = -1075, 1025


def _placed(df: DataFrame) -> DataFrame:
    """Add ``_cell``, which never decreases with ``_x``, and ``_slice``, which never
    decreases with ``_x`` inside a cell.

    Both are the whole and the fractional part of the scaled logarithm. The
    logarithm is monotone, so values it cannot tell apart share a slice and order
    is kept. Both columns are made non-null so that joins on them do not repeat
    these expressions in a filter.
    """
    size = F.abs("_x")
    plain = (size > 0) & (size < float("inf"))
    last_cell = (HIGHEST_LOG - LOWEST_LOG) * CELLS_PER_BINADE
    scaled = (F.log2(size) - F.lit(float(LOWEST_LOG))) * float(CELLS_PER_BINADE)
    place = (
        F.when(plain, scaled).when(size == 0, F.lit(0.0)).otherwise(F.lit(float(last_cell)))
    )
    return (
        df.withColumn("_place", place)
        .withColumn("_sign", F.when(F.col("_x") < 0, -1).otherwise(1))
        .withColumn("_cell", F.coalesce(F.col("_sign") * F.floor("_place"), F.lit(0)))
        .withColumn(
            "_slice",
            F.coalesce(
                F.col("_sign")
                * F.floor((F.col("_place") - F.floor("_place")) * float(SLICES_PER_CELL)),
                F.lit(0),
            ),
        )
        .drop("_place", "_sign")
    )


def _running(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(
        "_before",
        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n"),
    )


def ranked_values(df: DataFrame, value: str, ranks: Column, by: Sequence[str] = ()) -> DataFrame:
    """The values at given 0-based ranks of each group.

    ``ranks`` is an array of structs with a ``bigint`` field ``rank``, computed
    from the group size ``_size``. The result has ``by``, the struct as ``_want``
    and the ``double`` ``value``. Rows with a null group or value are left out.
    The number of groups times the number of ranks is broadcast, so groups must
    be few: columns, categories or classes, not patients.
    """
    by = list(by)
    clean = df.select(
        *by, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("_x")
    ).where(F.col("_x").isNotNull())
    for key in by:
        clean = clean.where(F.col(key).isNotNull())
    if not by:
        clean = clean.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    celled = _placed(clean)

    cells = celled.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    cells = _running(cells, keys, "_cell").withColumn(
        "_size", F.sum("_n").over(Window.partitionBy(*keys))
    )
    first = F.transform(
        ranks, lambda w: F.struct(w.alias("want"), w["rank"].alias("rest"))
    )
    hit_cells = _hits(cells.withColumn("_wants", first), [*keys, "_cell"])

    values = (
        celled.join(hit_cells.drop("_wants"), [*keys, "_cell"])
        .groupBy(*keys, "_cell", "_slice", "_x")
        .agg(F.count("*").alias("_n"))
    )
    slices = values.groupBy(*keys, "_cell", "_slice").agg(F.sum("_n").alias("_n"))
    slices = _running(slices, [*keys, "_cell"], "_slice")
    hit_slices = _hits(
        slices.join(hit_cells, [*keys, "_cell"]), [*keys, "_cell", "_slice"]
    )

    inside = values.join(hit_slices, [*keys, "_cell", "_slice"])
    found = _hits(_running(inside, [*keys, "_cell", "_slice"], "_x"), [*by, "_x"])
    return found.select(*by, F.explode("_wants").alias("_want"), F.col("_x").alias("value")).select(
        *by, F.col("_want.want").alias("_want"), "value"
    )


def _hits(counted: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that hold wanted ranks, with those ranks counted from the row's start."""
    start, end = F.col("_before"), F.col("_before") + F.col("_n")
    inside = F.filter("_wants", lambda w: (w["rest"] >= start) & (w["rest"] < end))
    moved = F.transform(
        inside, lambda w: F.struct(w["want"].alias("want"), (w["rest"] - start).alias("rest"))
    )
    return counted.select(*columns, moved.alias("_wants")).where(F.size("_wants") > 0)


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Interpolated quantiles: one row per group and probability ``p``.

    Columns: ``by``, ``p`` and ``quantile``. Same result as ``percentile``.
    """
    position = [F.lit(float(p)) * (F.col("_size") - 1) for p in probs]
    ranks = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("p"),
                F.lit(side).alias("side"),
                (F.floor(h) if side == "low" else F.ceil(h)).cast("bigint").alias("rank"),
                (h - F.floor(h)).alias("weight"),
            )
            for p, h in zip(probs, position)
            for side in ("low", "high")
        ]
    )
    found = ranked_values(df, value, ranks, by)
    low = F.max(F.when(F.col("_want.side") == "low", F.col("value")))
    high = F.max(F.when(F.col("_want.side") == "high", F.col("value")))
    weight = F.max("_want.weight")
    mixed = F.when(low == high, low).otherwise(low * (1 - weight) + high * weight)
    return (
        found.withColumn("p", F.col("_want.p"))
        .groupBy(*by, "p")
        .agg(mixed.alias("quantile"))
    )


def exact_median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return exact_quantiles(df, value, [0.5], by).drop("p").withColumnRenamed("quantile", "median")
