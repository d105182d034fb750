"""Approximate nearest neighbours by stable projections and a kd-tree.

Largest inner product becomes smallest distance by one more component, sqrt(M^2 - |x|^2). All rows are
projected to a few dimensions by one Gaussian (2-stable) matrix. A kd-tree, whose upper part is fitted on a
bounded sample of projections, cuts them into shards; each shard is a subtree that one task goes through.
For a vector at distance D the squared projected distance over D^2 is chi-square distributed, so once
a box of projections is farther than the quantile allows for the k-th distance found so far, a better vector
is left out with probability 1 - confidence only. A query takes the leaves of its nearest shard in order of
projected distance and tests before each leaf whether to stop; of a leaf's vectors, those whose own projections
pass the test are verified in full dimension. Then it goes, with the k-th distance found, to those other
shards only that pass the same test.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.common import staged
from sightline.llm.topk import clean_vectors, matrix, merge_tree

SHARD_ROWS, TILE_QUERIES, LEAF = 4096, 2048, 32
#: Pairs of vectors multiplied at once.
PAIRS = 4096
#: Distinct vectors, about, that the upper tree is fitted on; shards of it at most; lengths with a tree of their own.
SAMPLE, MAX_SHARDS, MAX_WIDTHS = 16_384, 1024, 64
#: Shards that vectors of other lengths are dealt to.
OTHER_SHARDS = 16


def chi_square_quantile(p: float, freedom: int) -> float:
    """For an even number of degrees of freedom, where the distribution function is a finite sum."""
    if freedom % 2:
        raise ValueError("the number of projections must be even")

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers per leaf; every split halves the rows along the widest dimension."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            leaves.append(rows)
            continue
        here = points[rows]
        axis = int(np.argmax(here.max(axis=0) - here.min(axis=0)))
        order = np.argsort(here[:, axis], kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return leaves


def _keep_best(score: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if score.shape[1] <= k:
        return score, place
    at = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return np.take_along_axis(score, at, axis=1), np.take_along_axis(place, at, axis=1)


def projection(width: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width + 1, dims))


def projected(vectors: np.ndarray, stable: np.ndarray, longest2: float) -> np.ndarray:
    extra = np.sqrt(np.maximum(longest2 - np.einsum("ij,ij->i", vectors, vectors), 0.0))
    return vectors @ stable[:-1] + extra[:, None] * stable[-1]


def box_distance2(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every point from every box."""
    total = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        at = points[:, axis, None]
        total += np.maximum(np.maximum(low[:, axis] - at, at - high[:, axis]), 0.0) ** 2
    return total


def cut_tree(points: np.ndarray, leaves: int, first: int) -> tuple:
    """A kd-tree of at most ``leaves`` leaves, numbered from ``first``: (axis, cut, left, right) or a number.

    Points up to the cut go left. Points that cannot be told apart share a leaf.
    """
    if leaves <= 1 or len(points) < 2:
        return first
    axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
    values = np.sort(points[:, axis])
    below = values[values < values[-1]]
    if not len(below):
        return first
    cut = float(below[min(len(below), (len(points) + 1) // 2) - 1])
    left = points[:, axis] <= cut
    share = leaves // 2
    return (axis, cut, cut_tree(points[left], leaves - share, first), cut_tree(points[~left], share, first + leaves - share))


def leaf_of(points: np.ndarray, tree: tuple | int) -> np.ndarray:
    out = np.zeros(len(points), dtype=np.int32)
    todo = [(np.arange(len(points)), tree)]
    while todo:
        rows, node = todo.pop()
        if isinstance(node, int):
            out[rows] = node
            continue
        axis, cut, left, right = node
        here = points[rows, axis] <= cut
        todo += [(rows[here], left), (rows[~here], right)]
    return out


def search_shard(
    queries: np.ndarray, vectors: np.ndarray, longest2: float, k: int, stable: np.ndarray, limit: float, known: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the places in ``vectors`` of the k largest inner products found (-1 where none), these products,
    and how many vectors were verified.

    ``known`` holds per query a k-th largest product that is known from elsewhere.
    """
    low, near = projected(vectors, stable, longest2), queries @ stable[:-1]
    farthest = longest2 + np.einsum("ij,ij->i", queries, queries)
    leaves = kd_leaves(low)
    members = np.full((len(leaves), max(map(len, leaves))), -1)
    for rows, line in zip(leaves, members):
        line[: len(rows)] = rows
    bounds = box_distance2(
        near, np.array([low[rows].min(axis=0) for rows in leaves]), np.array([low[rows].max(axis=0) for rows in leaves])
    )
    order = np.argsort(bounds, axis=1, kind="stable")
    best = np.full((len(queries), k), -np.inf)
    place = np.full((len(queries), k), -1, dtype=np.int64)
    verified = np.zeros(len(queries), dtype=np.int64)
    active = np.arange(len(queries))
    for step in range(len(leaves)):
        worst = np.maximum(best[active].min(axis=1), known[active])
        reach = np.where(np.isfinite(worst), limit * np.maximum(farthest[active] - 2 * worst, 0.0), np.inf)
        # Leaves come in order, so a query whose next leaf fails the test is done.
        going = bounds[active, order[active, step]] <= reach
        active, reach = active[going], reach[going]
        if not len(active):
            break
        leaf = order[active, step]
        rows = members[leaf]
        gap = near[active][:, None, :] - low[rows]
        passing = (np.einsum("ijk,ijk->ij", gap, gap) <= reach[:, None]) & (rows >= 0)
        verified[active] += passing.sum(axis=1)
        which, member = np.nonzero(passing)
        score = np.full(passing.shape, -np.inf)
        for start in range(0, len(which), PAIRS):
            r, c = which[start : start + PAIRS], member[start : start + PAIRS]
            score[r, c] = np.einsum("ij,ij->i", queries[active[r]], vectors[rows[r, c]])
        best[active], place[active] = _keep_best(
            np.hstack([best[active], score]), np.hstack([place[active], np.where(passing, rows, -1)]), k
        )
    return place, best, verified


def _by_width(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length of the vectors: the length, the row numbers and the vectors."""
    widths = batch.column("width").to_numpy()
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        yield width, rows, matrix(batch.column(name).take(pa.array(rows)), width)


def _per_shard(numbers: list[int]) -> Column:
    """The number of the row's shard; as many as there are shards, which are bounded."""
    return F.element_at(F.lit(numbers), F.col("shard") + 1)


def neighbour_lists(
    vectors: DataFrame, k: int, every: int, dims: int, confidence: float, seed: int, shard_rows: int
) -> tuple[DataFrame, int]:
    """Per query and shard visited the best found: (query_id, shard, best, kth, verified); and the number of shards.

    ``best`` is an array of (minus, vec_id) in order, ``verified`` counts the index entries whose vectors
    were compared in full dimension.
    """
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = staged(
        clean_vectors(vectors, 0).where(norm2 > 0).select("vec_id", "v", F.size("v").alias("width")), "vectors"
    )
    n, longest2 = rows.agg(F.count("*"), F.max(norm2)).first()
    longest2 = (longest2 or 0.0) * (1 + 1e-12)
    limit = chi_square_quantile(confidence, dims)

    # The upper tree, from a sample of distinct vectors.
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, _, found in _by_width(batch, "v"):
                low = projected(found, projection(width, dims, seed), longest2)
                yield pa.RecordBatch.from_pydict({"width": pa.array([width] * len(low), pa.int32()), "low": pa.array(list(low), pa.list_(pa.float64()))})

    share = min(1.0, SAMPLE / max(n, 1))
    drawn = rows.where(F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample: dict[int, list] = {}
    for r in drawn.select("v", "width").mapInArrow(project, "width int, low array<double>").distinct().orderBy("width", "low").collect():
        sample.setdefault(r["width"], []).append(r["low"])
    widest = sorted(sample, key=lambda w: (-len(sample[w]), w))[:MAX_WIDTHS]
    total = sum(len(x) for x in sample.values())
    trees: dict[int, tuple[tuple | int, int, int]] = {}
    shards = OTHER_SHARDS
    for width in widest:
        leaves = max(1, min(MAX_SHARDS, math.ceil(len(sample[width]) / total * n / shard_rows)))
        trees[width] = (cut_tree(np.array(sample[width]), leaves, shards), shards, leaves)
        shards += leaves

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, at, found in _by_width(batch, "v"):
                low = projected(found, projection(width, dims, seed), longest2)
                shard = leaf_of(low, trees[width][0]) if width in trees else np.full(len(low), width % OTHER_SHARDS, np.int32)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(shard), pa.array(list(low), pa.list_(pa.float64()))], names=[*part.schema.names, "shard", "low"]
                )

    # Equal vectors are one entry; a task sees at most k + 1 of their ids from each part of the input.
    first = Window.partitionBy("v").orderBy("vec_id")
    entries = staged(
        rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
        .groupBy("v", "width").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .mapInArrow(deal, "v array<double>, width int, ids array<long>, shard int, low array<double>"),
        "entries",
    )
    ends = [f(F.get("low", F.lit(i))).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(dims)]
    parts, low, high = [1] * shards, np.full((shards, dims), np.inf), np.full((shards, dims), -np.inf)
    for r in entries.groupBy("shard").agg(F.count("*").alias("n"), *ends).collect():  # one row a shard
        parts[r["shard"]] = math.ceil(r["n"] / (2 * shard_rows))
        low[r["shard"]], high[r["shard"]] = r[2 : 2 + dims], r[2 + dims :]

    def visit(batches: Iterator[pa.RecordBatch], home: bool) -> Iterator[pa.RecordBatch]:
        """The nearest shard, or all others that pass the test with the k-th product known."""
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                some = batch.slice(start, 512)
                for width, at, asked in _by_width(some, "query"):
                    _, begin, count = trees.get(width, (None, width % OTHER_SHARDS, 1))
                    bound = box_distance2(asked @ projection(width, dims, seed)[:-1], low[begin : begin + count], high[begin : begin + count])
                    nearest = bound.argmin(axis=1)
                    if home:
                        chosen = [[begin + int(i)] for i in nearest]
                    else:
                        kth = some.column("kth").take(pa.array(at)).to_numpy(zero_copy_only=False)
                        far2 = np.where(np.isfinite(kth), longest2 + np.einsum("ij,ij->i", asked, asked) - 2 * kth, np.inf)
                        fits = np.isfinite(bound) & (bound <= limit * np.maximum(far2, 0.0)[:, None])
                        fits[np.arange(len(fits)), nearest] = False
                        chosen = [(begin + np.flatnonzero(line)).tolist() for line in fits]
                    part = some.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(chosen, pa.list_(pa.int32()))], names=[*part.schema.names, "shards"])

    kind = pa.list_(pa.struct([("minus", pa.float64()), ("vec_id", pa.int64())]))
    made = pa.schema([("query_id", pa.int64()), ("shard", pa.int32()), ("best", kind), ("kth", pa.float64()), ("verified", pa.int64())])

    def tile(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return made.empty_table()
        width, shard = q.column("width")[0].as_py(), q.column("shard")[0].as_py()
        own, asked, given = q.column("query_id").to_numpy(), matrix(q.column("query"), width), matrix(c.column("v"), width)
        ids = c.column("ids").to_pylist()
        # One more than k: the query itself may be among the found.
        found, score, verified = search_shard(asked, given, longest2, k + 1, projection(width, dims, seed), limit, q.column("kth").to_numpy())
        best = []
        for vector, mine, places in zip(asked, own, found):
            places = places[places >= 0]
            # Row by row, so that equal vectors score equally whatever else is in the tile.
            exact = (given[places] * vector).sum(axis=1)
            hits = sorted((-float(s), v) for s, p in zip(exact, places) for v in ids[p] if v != mine)
            best.append([{"minus": s, "vec_id": v} for s, v in hits[:k]])
        return pa.table([pa.array(own), pa.array([shard] * len(own), pa.int32()), pa.array(best, kind), pa.array(score.min(axis=1)), pa.array(verified)], schema=made)

    def search(asking: DataFrame, home: bool, name: str) -> DataFrame:
        visits = staged(
            asking.mapInArrow(lambda b: visit(b, home), "query_id long, query array<double>, width int, kth double, shards array<int>")
            .select("query_id", "query", "width", "kth", F.explode("shards").alias("shard")),
            name,
        )
        blocks = [0] * shards
        for r in visits.groupBy("shard").agg(F.count("*").alias("n")).collect():  # one row a shard
            blocks[r["shard"]] = math.ceil(r["n"] / TILE_QUERIES)
        upto = lambda column: F.explode(F.sequence(F.lit(0), column - 1))
        keys = ["width", "shard", "part", "block"]
        asked = visits.withColumn("part", upto(_per_shard(parts))).withColumn(
            "block", F.pmod(F.xxhash64("query_id", F.lit(1)), _per_shard(blocks)).cast("int")
        )
        others = (
            entries.where(_per_shard(blocks) > 0).withColumn("part", F.pmod(F.xxhash64("v", F.lit(3)), _per_shard(parts)).cast("int"))
            .withColumn("block", upto(_per_shard(blocks))).select("v", "ids", *keys)
        )
        return asked.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(
            tile, "query_id long, shard int, best array<struct<minus:double,vec_id:long>>, kth double, verified long"
        )

    none = F.lit(float("-inf"))
    asking = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"), "width")
    near = staged(search(asking.withColumn("kth", none), True, "home_visits"), "home_lists")
    known = near.groupBy(F.col("query_id").alias("known_id")).agg(F.max("kth").alias("kth"))
    further = asking.join(known, F.col("query_id") == F.col("known_id"), "left").select("query_id", "query", "width", F.coalesce("kth", none).alias("kth"))
    return near.unionByName(search(further, False, "further_visits")), shards


def nearest_neighbours(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    dims: int = 16,
    confidence: float = 0.97,
    seed: int = 11,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The k nearest found by largest inner product for every vec_id divisible by ``every``.

    All rows are indexed and can be found; the query's own vec_id is left out. Returns query_id, rank
    (from 1), vec_id and score, the inner product of the original vectors in double precision; ties go to
    the smaller vec_id. Equal vectors share one entry of the index, which holds as many of their smallest
    ids as a result can need. Vectors that are null, zero, or hold null or non-finite components, and rows
    without vec_id take no part; rows that repeat a vec_id count once, with their smallest vector; vectors
    meet only those of their own length. An empty table gives an empty result.

    The cuts between shards come from about 16,384 distinct vectors, drawn by hash; a shard that holds more
    than its share of the rows is split by hash into parts, each of which its queries visit.
    """
    lists, shards = neighbour_lists(vectors, k, every, dims, confidence, seed, shard_rows)
    return (
        merge_tree(lists.select("query_id", "shard", "best"), shards, k)
        .select("query_id", F.posexplode("best").alias("at", "hit"))
        .select(
            "query_id", (F.col("at") + 1).cast("int").alias("rank"),
            F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"),
        )
    )
