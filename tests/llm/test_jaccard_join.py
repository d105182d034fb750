import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm.components import connected_components
from sightline.llm import jaccard_join
from sightline.llm.jaccard_join import least_needed, ngram_jaccard_join
from sightline.llm.queries import op5_ngram_jaccard
from tests.llm.conftest import no_documents, odd_documents, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words):
    found = WORD.findall((text or "").translate(LOWER))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def brute(docs, words, num, den):
    """{doc_id: (size, component)} by all pairs."""
    sets = {i: shingles(t, words) for i, t in docs}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and den * min(len(a), len(b)) >= num * max(len(a), len(b)):
                common = len(a & b)
                if den * common >= num * (len(a) + len(b) - common):
                    low, high = sorted((top(i), top(j)))
                    root[high] = low
    return {i: (len(sets[i]), top(i)) for i in ids}


def found(rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_all_documents(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in rows_of("documents")]
    assert found(op5_ngram_jaccard(spark, small).collect()) == brute(docs, 3, 90, 100)


@pytest.mark.parametrize("words, num, den", [(1, 8, 10), (3, 9, 10), (5, 8, 10)])
def test_families_of_copies(spark, words, num, den):
    """Families around a base, chains of small edits, short texts at the threshold, a shared passage."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    passage = [word() for _ in range(60)]
    docs = []
    for _ in range(3):
        base = [word() for _ in range(120)]
        chain = list(base)
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randrange(12)):
                copy[rng.randrange(len(copy))] = word()
            docs.append(copy)
            chain[rng.randrange(len(chain))] = word()
            docs.append(list(chain))
    for _ in range(40):
        docs.append([word() for _ in range(rng.randrange(5, 60))] + passage)
    short = [word() for _ in range(14)]
    docs += [short[:n] for n in range(1, 15)] + [[*short, "Z"], [x.upper() for x in short]]
    rng.shuffle(docs)
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, words, num, den)
    assert len({c for _, c in want.values()}) < len(rows) - 30
    assert found(ngram_jaccard_join(df, words, (num, den)).collect()) == want


def test_odd_rows(spark):
    rows = ngram_jaccard_join(odd_documents(spark), 3, (90, 100)).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str)
    assert got == sorted([
        (1, 8, 1), (2, 0, 2), (3, 0, 3), (4, 5, 4), (5, 1, 5), (5, 1, 5), (None, 3, None), (None, 0, None), (6, 0, 6),
        (7, 4, 7), (8, 8, 1),
    ], key=str)
    assert ngram_jaccard_join(no_documents(spark)).collect() == []


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 140)] + [(300, 300), (None, 5)]
    edges += [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(90)]
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for i in sorted(near):
        todo = [] if i in want else [i]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = i
                todo += near[x]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len(want) and {r["node"]: r["component"] for r in rows} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("num,den", [(90, 100), (8, 10), (1, 2)])
def test_least_needed_is_the_least_over_the_sizes(spark, num, den):
    rng = random.Random(num)
    cases = []
    for _ in range(400):
        n = rng.randint(1, 400)
        low = rng.randint(max(1, n * num // den - 3), n * den // num + 1)
        cases.append((n, low, low + rng.choice([0, 1, 5, 60])))
    ceil = lambda a, b: -(-a // b)
    cases = [c for c in cases if max(c[1], ceil(c[0] * num, den)) <= min(c[2], c[0] * den // num)]
    rows = spark.createDataFrame(cases, "n long, low long, high long")
    got = rows.select("*", least_needed(F.col("n"), F.col("low"), F.col("high"), num, den).alias("x")).collect()
    one = lambda a, b: max(1, ceil(num * (a + b), num + den) - ceil(num * max(a, b), den) + 1)
    assert len(got) > 200
    for r in got:
        sizes = range(max(r["low"], ceil(r["n"] * num, den)), min(r["high"], r["n"] * den // num) + 1)
        assert r["x"] == min(one(r["n"], b) for b in sizes), r


def test_texts_that_share_an_id_keep_their_own_components(spark):
    first, other, last = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, first), (2, first + " z"), (2, other), (3, other + " z"), (4, last)]
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 5, (8, 10)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 1), (2, 2), (3, 2), (4, 4)]


def test_marks_rule_out_no_link_and_most_of_what_is_below(spark):
    rng = np.random.default_rng(2)
    rows, linked, below = [], [], []
    for i in range(300):
        n = int(rng.integers(20, 300))
        base = rng.integers(0, 2**63, n + n // 4, dtype=np.uint64)
        cut = int(rng.integers(0, n // 5))
        a, b = base[:n], base[cut : n + int(rng.integers(0, n // 4))]
        common = len(np.intersect1d(a, b))
        share = 100 * common / (len(a) + len(b) - common)
        (linked if share >= 90 else below if share < 80 else []).append(i)
        rows.append((i, len(a), len(b), jaccard_join._marks(a).tolist(), jaccard_join._marks(b).tolist()))
    df = spark.createDataFrame(rows, "i long, a int, b int, x array<long>, y array<long>")
    fit = jaccard_join._marks_fit(F.col("x"), F.col("y"), F.col("a"), F.col("b"), 90, 100)
    kept = {r["i"] for r in df.where(fit).select("i").collect()}
    assert len(linked) > 10 and len(below) > 100
    assert set(linked) <= kept and len(kept & set(below)) < len(below) / 10


def test_links_of_joined_components_do_not_become_rows(spark):
    """A set that its likeliest link joins to a component asks none of the others there."""
    members = spark.createDataFrame([(i, 7) for i in range(1, 31)] + [(40, 8), (41, 9)], "rep long, grp long")
    possible = spark.createDataFrame([(40, 7, list(range(1, 31))), (41, 7, [3, 2, 1])], "query long, grp long, possible array<long>")
    components = spark.createDataFrame([(i, 1) for i in [*range(1, 31), 40]], "node long, component long")
    got = jaccard_join._still_apart(possible, members, components).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(41, 1), (41, 2)]
