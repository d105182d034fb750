"""Prefix trie of conversations by a splitter-skeleton.

A conversation is a path of turn digests. Paths are dealt to shards by splitters, (path, conv_id) pairs
from a bounded sample, so that many copies of one path still spread over shards. The splitters' paths form
a small trie, the skeleton. Any other node lies within one shard, because a splitter that parts two of its
members would have its path as a prefix; the shard finishes it while it streams through its sorted paths.
Skeleton nodes may span shards: every shard gives partial sums for them, which are reduced by node and then
added up along the skeleton.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import pick, staged

#: Bytes of a turn's digest.
WIDE = 16
#: Turns of a splitter's path and shards at most: the skeleton has no more nodes than their product.
SPLITTER_TURNS, MAX_SHARDS = 256, 2048
#: Sampled conversations per shard, and ids in a chunk of a spanning node's own members.
PER_SHARD, CHUNK = 16, 4096
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversation_paths(turns: DataFrame, shared: int, group: int) -> DataFrame:
    """(conv_id, path, chars) of every rebuilt conversation; path joins the digests of its turns.

    Turns of one conversation are ordered by turn (null first), then by digest. Null roles and texts are
    empty. Rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = pick(turns, "conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.char_length(text).alias("chars"),
    )
    base = F.col("conv_id") - F.col("conv_id") % group
    # One shuffle by base serves the grouping and the join with the base's own turns.
    convs = (
        rows.withColumn("base", base).repartition("base").groupBy("base", "conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "chars"))).alias("turns"))
    )
    first = convs.where("conv_id = base").select("base", F.slice("turns", 1, shared - 1).alias("lent")) if shared > 1 else None
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared)).cast("int")
    if first is None:
        whole = F.col("turns")
    else:
        convs = convs.join(first, "base", "left")
        none = F.slice("turns", 1, 0)
        whole = F.concat(F.slice(F.coalesce("lent", none), F.lit(1), taken), F.slice(F.col("turns"), taken + 1, F.size("turns")))
    rebuilt = convs.select("conv_id", whole.alias("turns"))
    return rebuilt.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["chars"]).alias("chars"),
    )


def choose_splitters(paths: DataFrame, shard_convs: int, seed: int) -> list[tuple[bytes, int]]:
    """Up to MAX_SHARDS - 1 pairs (path, conv_id) that cut the sorted conversations into like shares.

    They come from a sample of about PER_SHARD conversations a shard. A longer path is cut to
    SPLITTER_TURNS turns; such a splitter stands before all conversations that begin with it.
    """
    n = paths.count()
    shards = min(MAX_SHARDS, -(-n // shard_convs))
    if shards < 2:
        return []
    limit = SPLITTER_TURNS * WIDE
    sampled = paths.sample(fraction=min(1.0, PER_SHARD * shards / n), seed=seed).select(
        F.substring("path", 1, limit).alias("path"), F.when(F.octet_length("path") <= limit, F.col("conv_id")).alias("conv_id")
    )
    least = -(2**63)
    rows = sorted((bytes(r["path"]), least if r["conv_id"] is None else r["conv_id"]) for r in sampled.collect())
    if not rows:
        return []
    return sorted({rows[len(rows) * i // shards] for i in range(1, shards)})


@dataclass
class Skeleton:
    """The trie of the splitters' paths; node 0 is the root."""

    numbers: dict[bytes, int] = field(default_factory=lambda: {b"": 0})
    parents: list[int] = field(default_factory=lambda: [-1])

    @staticmethod
    def of(splitters: list[tuple[bytes, int]]) -> Skeleton:
        found = Skeleton()
        for path, _ in splitters:
            above = 0
            for end in range(WIDE, len(path) + 1, WIDE):
                number = found.numbers.setdefault(path[:end], len(found.parents))
                if number == len(found.parents):
                    found.parents.append(above)
                above = number
        return found


class _Node:
    __slots__ = ("depth", "skeleton", "least", "members", "children", "leaves", "saved", "chars", "sha", "ends", "pending")

    def __init__(self, depth: int, chars: int, skeleton: int):
        self.depth, self.chars, self.skeleton = depth, chars, skeleton
        self.least: int | None = None
        self.members = self.children = self.leaves = self.saved = 0
        self.sha = None
        self.ends: list[int] = []
        self.pending: list[tuple] = []


#: Kinds of rows: a finished node; one whose parent is the skeleton node ``skeleton``; a partial sum of the
#: skeleton node ``skeleton``; ids of its own members.
DONE, BELOW, PART, ENDS = 0, 1, 2, 3
ROWS = (
    "kind int, skeleton int, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, chars int, first long, ids string"
)
_TYPES = [
    pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
    pa.int32(), pa.int64(), pa.string(),
]
_NAMES = [x.split()[0] for x in ROWS.split(", ")]


class _Sweep:
    """One pass over sorted (path, conv_id): an open node per turn of the present path.

    Held are the open nodes and, per open node outside the skeleton, its closed children until its
    smallest member is known.
    """

    def __init__(self, numbers: dict[bytes, int]):
        self.numbers = numbers
        self.out: list[tuple] = []
        self.open = [_Node(0, 0, 0)]
        self.path, self.shard = b"", -1

    def _close(self) -> None:
        node, above = self.open.pop(), self.open[-1] if self.open else None
        if node.skeleton >= 0:
            self._ends(node)
            if node.members:
                self.out.append((PART, node.skeleton, node.least, node.depth, None, node.members, node.children, node.leaves, node.saved, None, node.chars, None, None))
        else:
            if not node.children:
                node.leaves = 1
            node.saved += (node.members - 1) * node.chars
            for row in node.pending:
                self.out.append((DONE, None, *row[:2], node.least, *row[2:], None, None, None))
            sha = node.sha.hexdigest() if node.sha else _NO_ENDS
            row = (node.least, node.depth, node.members, node.children, node.leaves, node.saved, sha)
            if above.skeleton >= 0:
                self.out.append((BELOW, above.skeleton, *row[:2], None, *row[2:], None, None, None))
            else:
                above.pending.append(row)
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
        if above:
            above.members += node.members
            above.least = node.least if above.least is None else min(above.least, node.least)

    def _ends(self, node: _Node) -> None:
        if node.ends:
            ids = ",".join(map(str, node.ends))
            self.out.append((ENDS, node.skeleton, *[None] * 9, node.ends[0], ids))
            node.ends = []

    def _to(self, depth: int) -> None:
        while len(self.open) > depth + 1:
            self._close()

    def add(self, shard: int, path: bytes, conv_id: int, chars: list[int]) -> None:
        if shard != self.shard:
            # Between two shards of one task, another task may have members of the same node.
            self._ends(self.open[-1])
            self.shard = shard
        if path != self.path:
            same, most = 0, min(len(path), len(self.path))
            while same < most and path[same : same + WIDE] == self.path[same : same + WIDE]:
                same += WIDE
            self._to(same // WIDE)
            for end in range(same + WIDE, len(path) + 1, WIDE):
                above = self.open[-1].skeleton
                known = self.numbers.get(path[:end], -1) if above >= 0 else -1
                self.open.append(_Node(end // WIDE, chars[end // WIDE - 1], known))
            self.path = path
        node = self.open[-1]
        node.members += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        if node.skeleton >= 0:
            node.ends.append(conv_id)
            if len(node.ends) >= CHUNK:
                self._ends(node)
        elif node.sha is None:
            node.sha = hashlib.sha256(str(conv_id).encode())
        else:
            node.sha.update(f",{conv_id}".encode())

    def finish(self) -> None:
        self._to(0)
        self._close()

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def _shards(paths: DataFrame, splitters: list[tuple[bytes, int]]) -> DataFrame:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
            shard = pa.array([bisect.bisect_right(splitters, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, shard], names=[*batch.schema.names, "shard"])

    return paths.mapInArrow(deal, "conv_id long, path binary, chars array<int>, shard int")


def _swept(paths: DataFrame, splitters: list[tuple[bytes, int]], numbers: dict[bytes, int]) -> DataFrame:
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _Sweep(numbers)
        for batch in batches:
            for row in zip(*[batch.column(n).to_pylist() for n in ("shard", "path", "conv_id", "chars")]):
                at.add(*row)
                if len(at.out) >= CHUNK:
                    yield at.batch()
        at.finish()
        if at.out:
            yield at.batch()

    dealt = _shards(paths, splitters).repartition(len(splitters) + 1, "shard").sortWithinPartitions("path", "conv_id")
    return dealt.mapInArrow(sweep, ROWS)


def _ends_sha(chunks: DataFrame) -> DataFrame:
    """(skeleton, ends_sha256): hashes of each node's chunks in order, streamed; a hash has to be one pass."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([sha.hexdigest()])], names=["skeleton", "ends"])
        for batch in batches:
            for node, ids in zip(batch.column("skeleton").to_pylist(), batch.column("ids").to_pylist()):
                if node == now:
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    yield row()
                now, sha = node, hashlib.sha256(ids.encode())
        if sha:
            yield row()

    return chunks.repartition("skeleton").sortWithinPartitions("skeleton", "first").select("skeleton", "ids").mapInArrow(digest, "skeleton int, ends string")


def _combined(parts: DataFrame, skeleton: Skeleton) -> list[tuple]:
    """The skeleton's nodes from their partial sums, added up from the leaves (at most one row a node)."""
    reduced = {
        r["skeleton"]: r
        for r in parts.groupBy("skeleton").agg(
            F.min("conv_id").alias("least"), F.max("depth").alias("depth"), F.max("chars").alias("chars"),
            *[F.sum(n).alias(n) for n in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        ).collect()
    }
    n = len(skeleton.parents)
    children, leaves, saved = np.zeros((3, n), dtype=np.int64)
    rows = []
    for i in range(n - 1, -1, -1):  # a child has a greater number than its parent
        r, above = reduced.get(i), skeleton.parents[i]
        if r is None:
            continue
        children[i] += r["n_children"]
        leaves[i] = leaves[i] + r["n_leaves"] if children[i] else 1
        saved[i] += r["saved_tokens"] + (r["n_convs"] - 1) * r["chars"]
        if above >= 0:
            children[above] += 1
            leaves[above] += leaves[i]
            saved[above] += saved[i]
        parent = reduced[above]["least"] if above >= 0 else None
        rows.append((i, r["least"], r["depth"], parent, r["n_convs"], int(children[i]), int(leaves[i]), int(saved[i])))
    return rows


def prefix_trie(turns: DataFrame, shared: int = 6, group: int = 100, shard_convs: int = 500, seed: int = 5) -> DataFrame:
    """The prefix trie of rebuilt conversations, a row per node.

    Conversation c is rebuilt from the first h turns of conversation c - c % ``group`` (none if absent)
    and its own turns after the first h, with h = crc32(decimal c) % ``shared``; shared=1 leaves all as
    they are. Returns conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256. Turns are ordered by number, null first, equal
    numbers by content; repeated rows are turns of their own; null roles and texts are empty; rows without
    conv_id are left out. Without conversations there is no node. Other columns are ignored. A path takes
    20 bytes a turn and one conversation must fit a task; the members of a node need not.
    """
    paths = staged(conversation_paths(turns, shared, group), "paths")
    splitters = choose_splitters(paths, shard_convs, seed)
    skeleton = Skeleton.of(splitters)
    swept = staged(_swept(paths, splitters, skeleton.numbers), "nodes")
    spark = turns.sparkSession
    rows = _combined(swept.where(F.col("kind") == PART), skeleton)
    spanning = spark.createDataFrame(
        rows, "skeleton int, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    )
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    ends = _ends_sha(swept.where(F.col("kind") == ENDS))
    top = spanning.join(ends, "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(_NO_ENDS)))
    # The skeleton has at most MAX_SHARDS * SPLITTER_TURNS + 1 rows of 12 bytes here.
    above = F.broadcast(spanning.select("skeleton", F.col("conv_id").alias("above")))
    below = swept.where(F.col("kind") == BELOW).drop("parent_conv_id").join(above, "skeleton").withColumnRenamed("above", "parent_conv_id")
    done = swept.where(F.col("kind") == DONE)
    return top.select(*names).unionByName(below.select(*names)).unionByName(done.select(*names)).withColumn("depth", F.col("depth").cast("long"))
