import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.llm.line_dedup import LineSignatures, _bags, bags_apart, dedup_lines, probe_plan, segments, whole_runs, within_edits, without_lines
from sightline.llm.queries import op9_line_dedup
from tests.llm.conftest import no_documents, odd_documents, rows_of


def distance(a, b):
    row = list(range(len(a) + 1))
    for j, c in enumerate(b, 1):
        before, row[0] = row[0], j
        for i, d in enumerate(a, 1):
            before, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, before + (c != d))
    return row[-1]


short = st.text(alphabet="abc", max_size=14)


@settings(max_examples=800, deadline=None)
@given(short, short, st.integers(0, 5))
def test_banded_distance(a, b, limit):
    assert within_edits(a, b, limit) == (distance(a, b) <= limit)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcd", min_size=20, max_size=60), st.lists(st.tuples(st.integers(0, 59), st.sampled_from("abcdx"), st.integers(0, 2)), max_size=4), st.integers(0, 3))
def test_edited_lines_are_found(a, edits, limit):
    b = list(a)
    for at, c, kind in edits:
        at %= max(len(b), 1)
        if kind == 0 and b:
            b[at] = c
        elif kind == 1:
            b.insert(at, c)
        elif b:
            del b[at]
    b = "".join(b)
    d = distance(a, b)
    assert within_edits(a, b, limit) == (d <= limit)
    bags = [_bags(np.array([ord(c) for c in x], dtype=np.uint32), np.zeros(len(x), dtype=np.int64), 1) for x in (a, b)]
    assert bags_apart(*bags)[0] <= 2 * d
    if d <= limit:  # lines within the limit meet under a signature that one of them has indexed
        sigs = [{(seed, x[i:j]): own for seed, i, j, own in probe_plan(len(x), limit)} for x in (a, b)]
        index = [{(seed, x[i:j]) for seed, i, j, own in probe_plan(len(x), limit) if own} for x in (a, b)]
        assert index[0] & set(sigs[1]) or index[1] & set(sigs[0])


def test_signatures_name_the_planned_substrings():
    rng = random.Random(4)
    lines = ["".join(rng.choice("abc\U0001f600") for _ in range(n)) for n in [3, 3, 4, 5, 5, 9, 40, 40, 41, 42] * 3]
    got = LineSignatures(2)(lines, list(range(len(lines)))).to_pydict()
    want = [(number, seed, line[i:j], known) for number, line in enumerate(lines) for seed, i, j, known in probe_plan(len(line), 2)]
    assert got["line"] == [w[0] for w in want] and got["indexed"] == [w[3] for w in want]
    by_sig = {}
    for sig, (_, seed, part, _) in zip(got["sig"], want):
        by_sig.setdefault(sig, set()).add((seed, part))
    assert all(len(x) == 1 for x in by_sig.values()) and len(by_sig) == len({w[1:3] for w in want})
    assert LineSignatures(2)([], []).num_rows == 0


def test_segments():
    assert segments(10, 3) == [(0, 3), (3, 6), (6, 10)]


def test_whole_runs():
    keys = [1, 1, 2, 2, 2, 2, 3, 4, 4, 4]
    batches = [pa.record_batch([pa.array(keys[i : i + 3])], names=["k"]) for i in range(0, 10, 3)]
    tables = [t.column("k").to_pylist() for t in whole_runs(iter(batches), ["k"])]
    assert sum(tables, []) == keys
    assert all(not set(a) & set(b) for a, b in zip(tables, tables[1:]))


def brute(docs, max_edits, min_chars):
    """{doc_id: removed line numbers}; documents have distinct ids."""
    lines = [(i, n, x) for i, t in docs for n, x in enumerate((t or "").split("\n")) if t is not None and len(x) >= min_chars]
    different = sorted({x for _, _, x in lines}, key=lambda x: (len(x), x))
    root = {x: x for x in different}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    by_bag = [np.bincount([ord(c) % 64 for c in x], minlength=64) for x in different]
    for a, x in enumerate(different):
        for b in range(a - 1, -1, -1):
            y = different[b]
            if len(x) - len(y) > max_edits:
                break
            if np.abs(by_bag[a] - by_bag[b]).sum() <= 2 * max_edits and distance(x, y) <= max_edits:
                root[top(x)] = top(y)
    seen, removed = set(), {i: [] for i, _ in docs}
    for i, n, x in sorted(lines):
        if top(x) in seen:
            removed[i].append(n)
        seen.add(top(x))
    return removed


def test_all_documents(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in rows_of("documents")]
    want = brute(docs, 2, 40)
    rows = op9_line_dedup(spark, small).collect()
    assert {r["doc_id"]: r["removed"] for r in rows} == {i: ",".join(map(str, x)) for i, x in want.items()}
    assert any(r["n_removed"] for r in rows)
    for r in rows:
        assert r["n_lines"] == len(dict(docs)[r["doc_id"]].split("\n"))


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_templates_and_edits(spark, edits, monkeypatch):
    monkeypatch.setattr("sightline.llm.line_dedup.TILE", 5)
    rng = random.Random(edits)
    line = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    bases = [line(rng.randrange(20, 40)) for _ in range(12)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            x = list(rng.choice(bases))
            for _ in range(rng.randrange(0, 5)):
                x[rng.randrange(len(x))] = rng.choice("abcx")
            lines.append("".join(x))
        lines.append(f"page number {i:03d} of a very common template")
        docs.append((i, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: list(r["removed"]) for r in dedup_lines(df, edits, 20).collect()}
    assert got == brute(docs, edits, 20)


def test_odd_rows(spark):
    rows = dedup_lines(odd_documents(spark), 2, 5).collect()
    got = sorted(((r["doc_id"], r["n_lines"], tuple(r["removed"])) for r in rows), key=str)
    assert got == sorted([
        (1, 1, ()), (2, 1, ()), (3, 0, ()), (4, 1, ()), (5, 1, ()), (5, 1, ()), (None, 1, ()), (None, 0, ()), (6, 2, ()),
        (7, 2, ()), (8, 1, (0,)),
    ], key=str)
    assert dedup_lines(no_documents(spark)).collect() == []


def test_text_without_lines(spark):
    df = spark.createDataFrame([("a\nb\nc", [1]), ("a", [0]), ("a\n", []), (None, [])], "text string, removed array<int>")
    got = [r[0] for r in df.select(without_lines(F.col("text"), F.col("removed"))).collect()]
    assert got == ["a\nc", "", "a\n", None]
