import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sightline.llm.common import pick
from sightline.llm.queries import op12_importance
from sightline.llm.resampling import bit_sliced_sums, importance_resample, planes_of
from tests.llm.conftest import no_documents, odd_documents, rows_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def counts(text):
    w = words(text)
    return Counter(zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def brute(docs, target):
    """(doc_id, n_features, weight, score, rank) of all (doc_id, text)."""
    source, goal = Counter(), Counter()
    per_doc = [(i, len(words(t)), counts(t)) for i, t in docs]
    for _, _, c in per_doc:
        source.update(c)
    for t in target:
        goal.update(counts(t))
    all_s, all_t = source.total(), goal.total()
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * (all_s + 10_000) / ((source[b] + 1) * (all_t + 10_000))))
    gains = {b: gain(b) for b in source}
    rows, drawn_from = [], []
    for i, n, c in per_doc:
        weight = sum(gains[b] * k for b, k in c.items()) // c.total() if c else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, c.total(), weight, score, None])
        if n >= 20:
            drawn_from.append(rows[-1])
    drawn_from.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(drawn_from[: 25 * len(drawn_from) // 100], 1):
        row[4] = rank
    return rows


def key(r):
    return tuple((x is None, x or 0) for x in r)


def of(rows):
    return sorted((tuple(r[n] for n in ("doc_id", "n_features", "weight", "score", "rank")) for r in rows), key=key)


def test_all_documents(spark, small):
    want = brute([(r["doc_id"], r["text"]) for r in rows_of("documents")], [r["text"] for r in rows_of("benchmark")])
    got = of(op12_importance(spark, small).collect())
    assert got == sorted(map(tuple, want), key=key)
    ranks = sorted(r[4] for r in got if r[4])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 20


@pytest.mark.parametrize("buckets", [1, 63, 64, 65, 10_000])
def test_sums_by_planes(buckets):
    rng = np.random.default_rng(buckets)
    gains = rng.integers(-9000, 9000, buckets)
    sets = [rng.integers(0, high, buckets) for high in (1, 2, 3, 1000, 2**40)]
    column = pa.array([planes_of(c, buckets) for c in sets], pa.binary())
    assert bit_sliced_sums(column, gains).tolist() == [sum(int(a) * int(b) for a, b in zip(c, gains)) for c in sets]
    assert bit_sliced_sums(pa.array([b"", b""], pa.binary()), np.zeros(buckets, dtype=np.int64)).tolist() == [0, 0]


def test_ties_and_repeats(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["red", "Blue", "grün", "x-ray", "42"]) for _ in range(n))
    same = text(30)
    docs = [(i % 40, same if i % 3 else text(rng.randrange(15, 40))) for i in range(200)] + [(None, same)] * 80
    target = ["blue blue grün", None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = of(importance_resample(frame, goal).collect())
    assert got == sorted(map(tuple, brute(docs, target)), key=key)


def test_odd_rows(spark):
    df = odd_documents(spark)
    goal = spark.createDataFrame([("lorem ipsum", 1)], "text string, TEXT int")
    want = brute([(r["doc_id"], r["text"]) for r in pick(df, "doc_id", "text").collect()], ["lorem ipsum"])
    assert of(importance_resample(df, goal).collect()) == sorted(map(tuple, want), key=key)
    assert importance_resample(no_documents(spark), goal).collect() == []
    nothing = goal.limit(0)
    want = brute([(r["doc_id"], r["text"]) for r in pick(df, "doc_id", "text").collect()], [])
    assert of(importance_resample(df, nothing).collect()) == sorted(map(tuple, want), key=key)
