import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sightline.llm.mixing import PRIME, capped_targets, mix_sources, sainte_lague, words_of_spans
from sightline.llm.queries import op1_mix_sources
from tests.llm.conftest import no_documents, odd_documents, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_are_capped_and_reshared():
    assert capped_targets([10, 100, 100], [3, 1, 2], 100.0, 2.0) == pytest.approx([20, 80 / 3, 160 / 3])
    assert sum(capped_targets([10, 20, 30], [3, 1, 2], 90.0, 2.0)) == pytest.approx(90)


def test_sainte_lague_by_hand():
    # Quotients of 53, 24, 23 for seven seats: 53, 17.7, 10.6, 7.6 / 24, 8 / 23, 7.7.
    assert sainte_lague([53.0, 24.0, 23.0], 7) == [3, 2, 2]
    assert sainte_lague([1.0, 1.0], 1) == [1, 0]
    assert sainte_lague([0.0, 0.0], 5) == [0, 0]
    votes = [7.0, 1.5, 900.0, 33.3, 0.0]
    quotients = sorted(((v / (2 * k + 1), -i) for i, v in enumerate(votes) for k in range(300) if v), reverse=True)[:200]
    assert sainte_lague(votes, 200) == [sum(-i == n for _, i in quotients) for n in range(5)]


def test_mix_of_all_documents(spark, small):
    got = {r["doc_id"]: r for r in op1_mix_sources(spark, small).collect()}
    docs = {r["doc_id"]: r for r in rows_of("documents")}
    assert set(got) == set(docs)
    sizes, source_sizes, taken = {}, defaultdict(int), defaultdict(int)
    for i, d in docs.items():
        sizes[i] = len(WORD.findall(d["text"] or ""))
        source_sizes[d["source"]] += sizes[i]
    order = sorted(source_sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, capped_targets([source_sizes[s] for s in order], [[3, 1, 2][i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2.0)))
    for i, r in got.items():
        source = docs[i]["source"]
        assert (r["size"], r["source_size"]) == (sizes[i], source_sizes[source])
        assert r["target"] == pytest.approx(want[source])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(130, 0.03 * target)
    again = {r["doc_id"]: r["taken"] for r in op1_mix_sources(spark, small).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_shards_share_a_source(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = mix_sources(docs, shard_docs=2, block_words=10).collect()
    by_source = defaultdict(lambda: [0.0, 0])
    for r in rows:
        by_source[r["source"]][0] = r["target"]
        by_source[r["source"]][1] += r["taken"]
        assert r["taken"] == sum((s["end"] - s["start"]) * s["times"] for s in r["spans"])
    assert all(abs(t - n) <= max(60, 0.03 * t) for t, n in by_source.values())


def taken_by_hand(sizes, quota, block, turn):
    """Words taken of documents of the given sizes laid end to end: block after block in turn, the last in part."""
    words = sum(sizes)
    times = [0] * words
    for i in range(quota // words):
        times = [t + 1 for t in times]
    left = quota % words
    blocks = -(-words // block)
    for b in sorted(range(blocks), key=lambda b: turn(b, blocks)):
        for w in range(b * block, min(words, (b + 1) * block, b * block + left)):
            times[w] += 1
        left -= min(left, min(words, (b + 1) * block) - b * block)
    out, at = [], 0
    for n in sizes:
        out.append(sum(times[at : at + n]))
        at += n
    return out


def test_many_small_sources(spark):
    """No document beyond twice its size, and every source gives its target, however small."""
    texts = [("a", 64)] + [(f"b{i:02d}", 12) for i in range(40)] + [("c", 704), ("d", 0), (None, 5)]
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(texts)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        assert r["taken"] == min(round(r["target"]), 2 * r["source_size"])
        assert all(0 <= s["start"] < s["end"] <= r["size"] and s["times"] in (1, 2) for s in r["spans"])
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * sum(n for _, n in texts), abs=len(texts))


@pytest.mark.parametrize("block", [1, 7, 64])
def test_taken_blocks_by_hand(spark, block):
    """One shard a source: the blocks taken are those of the permutation, compared word by word."""
    rng = random.Random(block)
    docs = [(i, "w " * rng.choice([0, 1, 3, 20, 90]), rng.choice("xyz")) for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mix_sources(frame, block_words=block).collect()}
    keys = {
        r["doc_id"]: r["place"]
        for r in frame.select("doc_id", F.xxhash64(F.lit(17), F.col("doc_id"), F.xxhash64("text")).alias("place")).collect()
    }
    shifts = {r["i"]: r["h"] for r in spark.range(3).select(F.col("id").cast("int").alias("i"), F.xxhash64(F.lit(17), F.col("id").cast("int"), F.lit(0).cast("long")).alias("h")).collect()}
    for number, source in enumerate("xyz"):
        mine = sorted((i for i, _, s in docs if s == source), key=lambda i: keys[i])
        sizes = [got[i]["size"] for i in mine]
        turn = lambda b, blocks: (b * PRIME + shifts[number] % blocks) % blocks  # noqa: E731, B023
        want = taken_by_hand(sizes, round(got[mine[0]]["target"]), block, turn)
        assert [got[i]["taken"] for i in mine] == want


def test_odd_rows(spark):
    rows = mix_sources(odd_documents(spark)).collect()
    assert len(rows) == 11
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mix_sources(no_documents(spark)).collect() == []
    with pytest.raises(ValueError):
        mix_sources(odd_documents(spark), max_sources=2)


def test_words_of_spans():
    assert words_of_spans("a b  c\nd", [(0, 2), (2, 4)]) == "a b  c\nd"
    assert words_of_spans("a b  c\nd", [(3, 4), (0, 2)]) == "a b\nd"
