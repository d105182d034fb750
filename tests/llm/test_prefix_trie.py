import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sightline.llm import prefix_trie as module
from sightline.llm.common import pick
from sightline.llm.prefix_trie import Skeleton, choose_splitters, conversation_paths, prefix_trie
from sightline.llm.queries import op11_prefix_trie
from tests.llm.conftest import rows_of

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id long, turn long, role string, text string"


def brute(rows, shared=6):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v, key=lambda t: (t[:2], hashlib.md5(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).hexdigest()))] for c, v in convs.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % shared
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                kids[path[: d - 1]].add(path[:d])
        ends[path].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return [(min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], sha(p)) for p in members]


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)


def check(df, rows, shared=6, **options):
    got = [tuple(r[n] for n in NAMES) for r in prefix_trie(df, shared=shared, **options).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, shared), key=key)
    return got


def test_all_conversations(spark, small):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows_of("conversations")]
    got = [tuple(r[n] for n in NAMES) for r in op11_prefix_trie(spark, small).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("shard_convs", [1, 3, 20, 10_000])
def test_shards_of_any_size(spark, shard_convs, monkeypatch):
    """Few turn texts, so nodes are deep and shared; a third of all conversations are copies."""
    monkeypatch.setattr(module, "CHUNK", 7)
    rng = random.Random(9)
    rows = []
    for c in rng.sample(range(-150, 900), 150):
        n = rng.randrange(9)
        for t in range(n):
            rows.append((c, t, rng.choice(["user", "bot"]), "x" * rng.randrange(3)))
    rows += [(c, t, "user", f"copy {t}") for c in range(2000, 2080) for t in range(3)]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    for shared in (6, 1):
        got = check(df, rows, shared, shard_convs=shard_convs)
        assert sum(r[1] == 0 for r in got) == 1


def test_splitters_part_copies_of_one_path(spark):
    rows = [(c, 0, "user", "the same") for c in range(400)]
    paths = conversation_paths(spark.createDataFrame(rows, TURNS), 1, 100)
    splitters = choose_splitters(paths, 50, 5)
    assert len(splitters) >= 5 and len({p for p, _ in splitters}) == 1
    assert len(Skeleton.of(splitters).numbers) == 2


def test_long_paths_have_bounded_splitters(spark, monkeypatch):
    monkeypatch.setattr(module, "SPLITTER_TURNS", 2)
    rows = [(c, t, "user", f"{t}" if t < 5 else f"{t} {c % 7}") for c in range(90) for t in range(8)]
    df = spark.createDataFrame(rows, TURNS)
    splitters = choose_splitters(conversation_paths(df, 1, 100), 10, 5)
    assert all(len(p) <= 2 * module.WIDE for p, _ in splitters)
    check(df, rows, shard_convs=10)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, "😀é"), (2, None, "", ""), (None, 0, "user", "lost"),
        (100, 0, "user", "a" * 100_000), (100, 1, "bot", "b"), (101, 0, "user", ""), (150, 3, "user", "late"), (-5, 0, "u", "v"), (0, None, "user", "zero"),
        (3, 1, "ab", "c"), (4, 1, "a", "bc"),
    ]
    extra = [(*r, "other", 1.5) for r in rows]
    df = spark.createDataFrame(extra, TURNS + ", TEXT string, depth double")
    check(df, rows, shard_convs=2)
    check(df, rows, shared=1, shard_convs=1)
    assert prefix_trie(pick(df, "conv_id", "turn", "role", "text").limit(0)).collect() == []
