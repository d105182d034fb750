"""Exact top-k search: tiled matrix products, selection per tile, tree merging of the lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import pick, staged

#: Queries and candidates in a tile at most, shards at least, and lists merged at once.
TILE_QUERIES, TILE_ROWS, MIN_SHARDS, FAN_IN = 2048, 4096, 8, 16


def usable(vector: Column) -> Column:
    """Whether a vector is not null and holds finite numbers only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def clean_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and ``v``: floor(scale * x) as doubles. Of rows sharing a vec_id the smallest vector stays."""
    rows = pick(vectors, "vec_id", "embedding").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")
    )
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col("x")))
    whole = F.transform("x", lambda x: F.floor(x * scale).cast("double")) if scale else F.col("x")
    return good.groupBy("vec_id").agg(F.min("x").alias("x")).select("vec_id", whole.alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where these are exact, else in Python's integers.

    Sums beyond 64 bits are held at the ends of the 64-bit range.
    """
    top = (np.abs(a).max() if a.size else 0.0) * (np.abs(b).max() if b.size else 0.0) * max(a.shape[1], 1)
    if top < 2.0**53:
        return (a @ b.T).astype(np.int64)
    big = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return np.clip(big(a) @ big(b).T, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def best_of_tile(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row the places of the k highest scores, ties to the smaller id; ``ids`` must ascend."""
    scores = scores.astype(np.float64) if scores.dtype.kind == "f" else scores
    found = []
    for row, mine in zip(scores, own):
        keep = min(k + 1, len(row))  # the query itself may be among them
        edge = np.partition(row, len(row) - keep)[len(row) - keep] if len(row) else 0
        places = np.flatnonzero(row >= edge)
        places = places[ids[places] != mine]
        order = np.argsort(-row[places].astype(object) if row.dtype.kind == "O" else -row[places], kind="stable")
        found.append(places[order[:k]])
    return found


def merge_tree(lists: DataFrame, shards: int, k: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge per-shard lists (query_id, shard, best) level by level until one list a query is left."""
    while True:
        shards = math.ceil(shards / fan_in)
        lists = (
            lists.withColumn("shard", F.floor(F.col("shard") / fan_in))
            .groupBy("query_id", "shard")
            .agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        )
        if shards <= 1:
            return lists


def exact_top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    scale: int = 256,
    tile_queries: int = TILE_QUERIES,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """The k candidates with the highest integer inner product for every query, exactly.

    Components become floor(scale * x). Queries are the vectors whose vec_id is divisible by ``every``;
    each meets all other vectors, tile by tile. Ties go to the smaller vec_id. Vectors that are null, or
    hold null or non-finite components, and rows without vec_id take no part; rows that repeat a vec_id
    count once, with their smallest vector. Vectors of another length than the query's are no candidates
    of it, so vectors without components meet only each other, with a score of 0. Returns query_id, rank
    (from 1), vec_id and score; an empty table gives an empty result.
    """
    rows = staged(clean_vectors(vectors, scale).withColumn("width", F.size("v")), "vectors")
    n = rows.count()
    shards = max(MIN_SHARDS, math.ceil(n / tile_rows))
    blocks = max(1, math.ceil(n / every / tile_queries))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    queries = rows.where(is_query).withColumn("block", block).withColumn("shard", each(shards))
    others = rows.withColumn("shard", shard).withColumn("block", each(blocks))

    def tile(q: pa.Table, c: pa.Table) -> pa.Table:
        names = ["query_id", "shard", "best"]
        kind = pa.list_(pa.struct([("minus", pa.int64()), ("vec_id", pa.int64())]))
        if not q.num_rows or not c.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], kind)], names=names)
        width = q.column("width")[0].as_py()
        c = c.sort_by("vec_id")
        ids, own = c.column("vec_id").to_numpy(), q.column("query_id").to_numpy()
        score = products(matrix(q.column("query"), width), matrix(c.column("v"), width))
        best = [
            [{"minus": -int(s), "vec_id": int(v)} for s, v in zip(line[places], ids[places])]
            for line, places in zip(score, best_of_tile(score, ids, own, k))
        ]
        return pa.table([pa.array(own), pa.array([c.column("shard")[0].as_py()] * len(own)), pa.array(best, kind)], names=names)

    # Named apart: both sides come from one table, and a cogroup confuses columns they share.
    keys = ["width", "block", "shard"]
    asking = queries.select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("query"), *[F.col(c).alias(c) for c in keys]
    )
    lists = (
        asking.groupBy(*keys).cogroup(others.select("vec_id", "v", *keys).groupBy(*keys))
        .applyInArrow(tile, "query_id long, shard long, best array<struct<minus:long,vec_id:long>>")
    )
    return (
        merge_tree(lists, shards, k)
        .select("query_id", F.posexplode("best").alias("at", "hit"))
        .select(
            "query_id", (F.col("at") + 1).cast("int").alias("rank"),
            F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"),
        )
    )
