import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sightline.llm.ann import box_distance2, chi_square_quantile, cut_tree, kd_leaves, leaf_of, nearest_neighbours, neighbour_lists
from sightline.llm.queries import op3_nearest, op7_exact_top_k
from sightline.llm.topk import exact_top_k, products
from tests.llm.conftest import rows_of


def brute(vectors, every, k, scale):
    ids = sorted(i for i in vectors)
    out = {}
    for q in ids:
        if q % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], vectors[i])), i) for i in ids if i != q and len(vectors[i]) == len(vectors[q]))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_exact_top_k_of_all_embeddings(spark, small):
    vectors = {r["vec_id"]: [math.floor(256 * x) for x in r["embedding"]] for r in rows_of("embeddings")}
    assert lists(op7_exact_top_k(spark, small).collect()) == brute(vectors, 50, 5, 256)


def test_nearest_recall_of_all_embeddings(spark, small):
    vectors = {r["vec_id"]: r["embedding"] for r in rows_of("embeddings")}
    want, got = brute(vectors, 20, 20, 0), lists(op3_nearest(spark, small).collect())
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.95 * sum(len(x) for x in want.values())
    for q, found in got.items():
        for i, score in found:
            assert score == pytest.approx(sum(a * b for a, b in zip(vectors[q], vectors[i])), abs=1e-12)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (20, [1.0, 2.0]), (40, [1.0, 2.0]), (60, None), (80, []), (100, [nan, 1.0]), (120, [inf, 1.0]),
        (140, [None, 1.0]), (160, [0.0, 0.0]), (None, [1.0, 1.0]), (200, [1.0, 2.0]), (200, [1.0, 2.0]), (1, [-1.0, 3.0]),
        (300, [1.0, 2.0, 3.0]), (3, [2.0, 0.5, 1.0]),
    ]
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, V int")


def test_odd_vectors(spark):
    good = {0: [1, 2], 20: [1, 2], 40: [1, 2], 160: [0, 0], 200: [1, 2], 1: [-1, 3], 300: [1, 2, 3], 3: [2, 0.5, 1]}
    got = lists(exact_top_k(odd_vectors(spark), k=3, every=50).collect())
    scaled = {i: [math.floor(256 * x) for x in v] for i, v in good.items()}
    assert got == {q: v for q, v in brute(scaled, 50, 3, 256).items() if v}
    near = lists(nearest_neighbours(odd_vectors(spark), k=3, every=20).collect())
    want = brute({i: v for i, v in good.items() if any(v)}, 20, 3, 0)
    assert near == {q: v for q, v in want.items() if v}
    for f in (exact_top_k, nearest_neighbours):
        assert f(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_ties_of_one_common_vector(spark):
    common = [0.6, 0.8, 0.1]
    rows = [(i, common if i % 3 else [0.1 * (i % 7), 0.5, 0.2]) for i in range(2000)]
    vectors = {i: [float(np.float32(x)) for x in v] for i, v in rows}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(vectors, 400, 5, 0)
    assert {q: [i for i, _ in v] for q, v in lists(nearest_neighbours(df, k=5, every=400, shard_rows=300).collect()).items()} == {
        q: [i for i, _ in v] for q, v in want.items()
    }
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors.items()}
    assert lists(exact_top_k(df, k=5, every=400, tile_rows=100, tile_queries=2).collect()) == brute(whole, 400, 5, 256)


def test_large_numbers_stay_exact():
    a, b = np.array([[2.0**31, 1.0]]), np.array([[2.0**30, 3.0], [2.0**40, 1.0]])
    assert products(a, b).tolist() == [[2**61 + 3, 2**63 - 1]]


def test_chi_square_and_leaves():
    assert chi_square_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)
    leaves = kd_leaves(np.random.default_rng(1).normal(size=(777, 4)), 10)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(777)) and max(map(len, leaves)) <= 10


def test_empty_vectors_meet_only_each_other(spark):
    rows = [(50, []), (100, []), (7, []), (150, [1.0, 2.0]), (8, [2.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert lists(exact_top_k(df, k=5, every=50).collect()) == {50: [(7, 0), (100, 0)], 100: [(7, 0), (50, 0)], 150: [(8, 768 * 256)]}
    assert lists(exact_top_k(df.where("vec_id in (50, 150, 8)"), k=5, every=50).collect()) == {150: [(8, 768 * 256)]}


def test_upper_tree():
    points = np.random.default_rng(2).normal(size=(1000, 4)).round(1)
    for leaves in (1, 2, 7, 16):
        found = leaf_of(points, cut_tree(points, leaves, 5))
        assert set(found) == set(range(5, 5 + leaves)) and np.bincount(found)[5:].max() <= 2.5 * 1000 / leaves
    same = np.ones((50, 4))
    assert set(leaf_of(same, cut_tree(same, 8, 3))) == {3}
    two = np.repeat([[0.0, 1.0], [0.0, 2.0]], [40, 2], axis=0)
    assert leaf_of(two, cut_tree(two, 2, 0)).tolist() == [0] * 40 + [1] * 2
    assert box_distance2(np.array([[0.0, 0.0]]), np.array([[1.0, -1.0]]), np.array([[2.0, 3.0]])).tolist() == [[1.0]]


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(200, 32))
    points = middles[rng.integers(0, 200, 50_000)] + 0.4 * rng.normal(size=(50_000, 32))
    points[::3] = points[0]  # one vector holds a third of the rows
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    path = str(tmp_path_factory.mktemp("vectors") / "t.parquet")
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(50_000)), "embedding": pa.array(list(points))}), path, row_group_size=5000)
    return points, spark.read.parquet(path)


def test_stop_acts_and_recall_holds(clustered):
    points, df = clustered
    every, k, n = 100, 20, len(points)
    distinct = len(np.unique(points, axis=0))
    got = lists(nearest_neighbours(df, k=k, every=every).collect())
    asked = list(range(0, n, every))
    assert sorted(got) == asked
    hits = {True: [], False: []}
    for q in asked:
        score = points @ points[q]
        score[q] = -np.inf
        edge = np.partition(score, n - k)[n - k]
        # Equally near vectors are as good as each other.
        hits[q % 3 == 0].append(sum(score[i] >= edge - 1e-12 for i, _ in got[q]) / k)
        assert len({i for i, _ in got[q]}) == k and q not in {i for i, _ in got[q]}
    assert np.mean(hits[False]) >= 0.9 and np.mean(hits[True]) >= 0.9
    found, shards = neighbour_lists(df, k, every, 16, 0.97, 11, 4096)
    visits, verified = found.agg(F.count("*"), F.sum("verified")).first()
    print("recall", np.mean(hits[False]), np.mean(hits[True]), "verified", verified / distinct / len(asked), "visits", visits / len(asked), "of", shards)
    assert verified < 0.2 * distinct * len(asked)
