"""N-gram Jaccard self-join by a token-group matrix.

Documents become sets of word shingles; equal sets are one class. Shingles are ordered by how often they
occur, rare ones first, so that a set's first few shingles (its prefix) are rare; two linked sets share at
least ``needed`` shingles of their prefixes. Similar sets are grouped: around pivots that agree in a
minimum hash, and, where no link to a pivot holds, by the minimum hash alone. Sets whose marks, a few bits
per set, differ by more than two linked sets can are never compared further. Every group's row of the
matrix holds the union of its members' prefix shingles, their sizes and how much follows. A set then asks
the matrix for the other groups, the overlap with a group's union bounds the overlap with every member,
and only groups that the bound does not rule out are opened. Of a set and a group the likeliest link is
verified first, with whole sets; the others only if the two are not in one component after that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import mixed, pick, staged
from sightline.llm.components import connected_components

#: Counters that shingles are hashed to, 2 ** COUNTERS_LOG of one byte each for every worker, in parts.
COUNTERS_LOG, PARTS_LOG = 24, 8
#: Members of a group, words that a worker remembers, shingles worked on at once, rows to broadcast.
GROUP, KNOWN_WORDS, AT_ONCE, MAX_BROADCAST = 32, 100_000, 250_000, 1_000_000
_M1 = np.uint64(0x9E3779B97F4A7C15)
#: An ordered shingle is its level above 57 bits of its hash.
_HASH_BITS = 57
#: Numbers of 64 bits that the marks of a set have.
MARKS = 8


class Shingles:
    """Sorted distinct 64-bit shingle hashes of texts; words are lower-cased A-Z, split at ASCII space."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not found:
            return np.zeros(0, dtype=np.uint64)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        for w in found:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
        size = min(self.words, len(hashes))
        out = np.full(len(hashes) - size + 1, np.uint64(size))
        for i in range(size):
            out = mixed(out * _M1 + hashes[i : len(hashes) - size + 1 + i])
        return np.unique(out)


def _in_chunks(batches: Iterator[pa.RecordBatch], words: int, *names: str) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """The named columns' values and the shingle sets of a bounded number of shingles at once."""
    shingles, ids, sets, size = Shingles(words), [], [], 0
    pa.default_memory_pool().release_unused()  # a worker serves several stages
    for batch in batches:
        for *row, text in zip(*[batch.column(n).to_pylist() for n in names], batch.column("text")):
            ids.append(tuple(row))
            sets.append(shingles(text.as_py()))
            size += len(sets[-1])
            if size > AT_ONCE:
                yield ids, sets
                ids, sets, size = [], [], 0
    if ids:
        yield ids, sets


def shingle_levels(docs: DataFrame, words: int) -> np.ndarray:
    """floor(log2) of the occurrences in all sets, per counter that shingles are hashed to.

    Levels only decide the order of shingles, which may be any: shingles that share a counter come later
    than they could. Tasks add up counters of their own and pass them on in compressed parts, so the data
    shuffled and the result (one byte a counter) are bounded.
    """
    size = 1 << (COUNTERS_LOG - PARTS_LOG)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS_LOG, dtype=np.uint16)  # a task's own counts stop at 65,535
        for _, sets in _in_chunks(batches, words, "doc_id"):
            different = {s.tobytes(): s for s in sets if len(s)}
            if different:
                at, n = np.unique(np.concatenate(list(different.values())) >> np.uint64(64 - COUNTERS_LOG), return_counts=True)
                total[at] = np.minimum(total[at] + n, 65_535)
        for part, counters in enumerate(total.reshape(-1, size)):
            if counters.any():
                packed = pa.compress(counters.tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names=["part", "counters"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(size, dtype=np.uint64)
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("counters").to_pylist()):
                if part != now:
                    if now is not None:
                        yield level(now, total)
                    now, total = part, np.zeros(size, dtype=np.uint64)
                total += np.frombuffer(pa.decompress(packed, 2 * size, codec="zstd", asbytes=True), dtype=np.uint16)
        if now is not None:
            yield level(now, total)

    def level(part: int, total: np.ndarray) -> pa.RecordBatch:
        found = np.maximum(np.frexp(total.astype(np.float64))[1] - 1, 0).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([found.tobytes()], pa.binary())], names=["part", "levels"])

    counted = docs.mapInArrow(count, "part int, counters binary")
    levels = counted.repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, levels binary")
    out = np.zeros((1 << PARTS_LOG, size), dtype=np.uint8)
    for row in levels.collect():  # at most 2 ** PARTS_LOG rows
        out[row["part"]] = np.frombuffer(row["levels"], dtype=np.uint8)
    return out.reshape(-1)


def _ordered(sets: list[np.ndarray], levels: np.ndarray) -> list[np.ndarray]:
    """Each set in the global order: by level, then by hash."""
    if not sets:
        return []
    whole = np.concatenate(sets)
    level = levels[(whole >> np.uint64(64 - COUNTERS_LOG)).astype(np.int64)].astype(np.int64)
    values = level << _HASH_BITS | (whole & np.uint64((1 << _HASH_BITS) - 1)).astype(np.int64)
    return [np.sort(x) for x in np.split(values, np.cumsum([len(s) for s in sets])[:-1])]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)))


def _marks(shingles: np.ndarray) -> np.ndarray:
    """One bit per hash value, set if an odd number of shingles has it."""
    odd = np.bincount((shingles & np.uint64(64 * MARKS - 1)).astype(np.int64), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SETS = "doc_id long, hash long, n int, key1 long, key2 long, low1 long, low2 long, prefix array<long>, marks array<long>"


def shingle_sets(docs: DataFrame, words: int, levels, num: int, den: int) -> DataFrame:
    """Per row the set's size, a 128-bit key of the set, two minimum hashes, the prefix and the marks."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _in_chunks(batches, words, "doc_id", "hash"):
            keys = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            half = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
            ordered = _ordered(sets, levels.value)
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(x, pa.int64()) for x in zip(*ids)], pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(half([k >> 64 for k in keys])), pa.array(half([k & (2**64 - 1) for k in keys])),
                    pa.array(half([s[0] if len(s) else 0 for s in sets])),
                    pa.array(half([(s * _M1).min() if len(s) else 0 for s in sets])),
                    _lists([x[: len(x) + (-num * len(x) // den) + 1] if len(x) else x for x in ordered]),
                    _lists([_marks(s) for s in sets]),
                ],
                names=["doc_id", "hash", "n", "key1", "key2", "low1", "low2", "prefix", "marks"],
            )

    return docs.mapInArrow(describe, SETS)


def least_overlap(a: Column, b: Column, num: int, den: int) -> Column:
    """Common shingles that two linked sets of sizes a and b have at least."""
    return -F.floor(-num * (a + b) / (num + den) + 1e-9)


def needed(a: Column, b: Column, num: int, den: int) -> Column:
    """Common prefix shingles that two linked sets of sizes a and b have at least (1 at least).

    Let x be the set whose prefix ends first in the order: whatever else its prefix holds is missing from
    the other set, so overlap <= n_x - (prefix length - common), with prefix length n_x - ceil(t n_x) + 1.
    """
    return F.greatest(F.lit(1), least_overlap(a, b, num, den) + F.floor(-num * F.greatest(a, b) / den + 1e-9) + 1)


def least_needed(n: Column, low: Column, high: Column, num: int, den: int) -> Column:
    """The least that ``needed`` asks of a set of size n and any size from low to high that can be linked.

    Up to n it grows with the other size. Beyond n it falls by t * t / (1 + t) a step, give or take two for
    rounding, so the last 3 * (1 + t) / (t * t) sizes hold the least.
    """
    low = F.greatest(low, -F.floor(-n * num / den + 1e-9)).cast("long")
    high = F.least(high, F.floor(n * den / num + 1e-9)).cast("long")
    steps = 3 * den * (num + den) // (num * num) + 1
    last = F.transform(F.sequence(F.greatest(low, high - steps), F.greatest(low, high)), lambda b: needed(n, b, num, den))
    return F.least(needed(n, low, num, den), F.array_min(last))


def _sizes_fit(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _marks_fit(marks_a: Column, marks_b: Column, a: Column, b: Column, num: int, den: int) -> Column:
    """Whether the marks allow a link: every bit that differs stands for a shingle that only one set has."""
    apart = sum((F.bit_count(marks_a[i].bitwiseXOR(marks_b[i])) for i in range(1, MARKS)), F.bit_count(marks_a[0].bitwiseXOR(marks_b[0])))
    return apart <= a + b - 2 * least_overlap(a, b, num, den)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The linked ones of pairs (a, b) of classes, by their whole sets."""
    either = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    asked = staged(either.join(classes.select("rep", F.col("doc_id").alias("asked_id")), "rep"), "asked")
    few = asked.count() <= MAX_BROADCAST
    same = F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("hash") == F.col("rep"))
    chosen = docs.join(F.broadcast(asked) if few else asked, same, "left_semi")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _in_chunks(batches, words, "hash"):
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(x, pa.int64()) for x in zip(*ids)], _lists([s.view(np.int64) for s in sets])], names=["rep", "tokens"]
            )

    whole = staged(chosen.mapInArrow(tokens, "rep long, tokens array<long>"), "whole")

    both = (
        pairs.join(whole.select(F.col("rep").alias("a"), F.col("tokens").alias("tokens_a")), "a")
        .join(whole.select(F.col("rep").alias("b"), F.col("tokens").alias("tokens_b")), "b")
        .select("a", "b", F.size("tokens_a").alias("n_a"), F.size("tokens_b").alias("n_b"), F.size(F.array_intersect("tokens_a", "tokens_b")).alias("common"))
    )
    linked = F.lit(den).cast("long") * F.col("common") >= F.lit(num).cast("long") * (F.col("n_a") + F.col("n_b") - F.col("common"))
    return staged(both, "common").where(linked).select("a", "b")


def _shared_prefix(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose marks allow a link and whose prefixes have enough in common for one."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("prefix").alias(f"prefix_{x}"), F.col("marks").alias(f"marks_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_marks_fit(F.col("marks_a"), F.col("marks_b"), F.col("n_a"), F.col("n_b"), num, den))
    common = F.size(F.array_intersect("prefix_a", "prefix_b"))
    return both.where(common >= needed(F.col("n_a"), F.col("n_b"), num, den)).select("a", "b")


def _pivot_pairs(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Every set with the pivot of its minimum-hash buckets, where their sizes and prefixes allow a link."""
    rare = F.size(F.filter("prefix", lambda x: x < 1 << _HASH_BITS)) / F.size("prefix")
    low = lambda i: F.struct(F.lit(i).alias("kind"), F.col(f"low{i}").alias("low"))
    entries = sets.select("rep", "n", rare.alias("rare"), F.explode(F.array(low(1), low(2))).alias("m")).select(
        "rep", "n", "rare", "m.kind", "m.low"
    )
    # The pivot holds the least that is its own.
    pivots = (
        entries.groupBy("kind", "low").agg(F.count("*").alias("members"), F.min(F.struct("rare", "rep", "n")).alias("pivot"))
        .where("members > 1").select("kind", "low", F.col("pivot.rep").alias("pivot"), F.col("pivot.n").alias("pivot_n"))
    )
    pairs = (
        entries.join(pivots, ["kind", "low"]).where(F.col("rep") != F.col("pivot"))
        .where(_sizes_fit(F.col("n"), F.col("pivot_n"), num, den))
        .select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b")).distinct()
    )
    return _shared_prefix(pairs, sets, num, den)


def _grouped(sets: DataFrame, first: DataFrame) -> DataFrame:
    """rep, n, prefix, marks, component and component_size: the linked sets by component, the others in groups.

    Sets without a link join others of their minimum hash, about GROUP at a time; such a group counts as a
    component of size 1, whose members are yet to be compared.
    """
    sizes = first.groupBy("component").agg(F.count("*").alias("component_size"))
    placed = sets.select("rep", "n", "prefix", "marks", "low1").join(first.withColumnRenamed("node", "rep"), "rep", "left").join(sizes, "component", "left")
    alone = placed.where(F.col("component").isNull())
    crowds = alone.groupBy("low1").agg(F.ceil(F.count("*") / GROUP).alias("chunks")).where("chunks > 1")
    chunk = F.pmod(F.xxhash64("rep"), F.coalesce("chunks", F.lit(1)))
    named = alone.join(crowds, "low1", "left").withColumn("component", F.xxhash64(F.lit("alone"), "low1", chunk))
    names = ["rep", "n", "prefix", "marks", "component"]
    return placed.where(F.col("component").isNotNull()).select(*names, "component_size").union(named.select(*names, F.lit(1).cast("long").alias("component_size")))


def _pairs_within(members: DataFrame, num: int, den: int) -> DataFrame:
    """Possible links inside the groups of sets without links, compared within the group's row."""
    groups = (
        members.where("component_size = 1").groupBy("grp")
        .agg(F.collect_list(F.struct("rep", "n", "prefix", "marks")).alias("inside")).where(F.size("inside") > 1)  # about GROUP members
    )
    linked = lambda a, b: (
        (b["rep"] < a["rep"]) & _sizes_fit(a["n"], b["n"], num, den) & _marks_fit(a["marks"], b["marks"], a["n"], b["n"], num, den)
        & (F.size(F.array_intersect(a["prefix"], b["prefix"])) >= needed(a["n"], b["n"], num, den))
    )
    pairs = F.flatten(
        F.transform("inside", lambda a: F.transform(F.filter("inside", lambda b: linked(a, b)), lambda b: F.struct(a["rep"].alias("a"), b["rep"].alias("b"))))
    )
    return groups.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def _by_group(sets: DataFrame) -> DataFrame:
    """The sets with ``grp``, a number of their group: about GROUP members of one component."""
    chunk = F.pmod(F.xxhash64("rep"), F.ceil(F.col("component_size") / GROUP))
    return sets.withColumn("grp", F.xxhash64("component", chunk))


def _matrix_links(members: DataFrame, num: int, den: int) -> DataFrame:
    """(query, grp, possible): the possible links of sets with groups of other components, likeliest first.

    Only groups that the matrix does not rule out are compared; a row holds about GROUP links at most.

    ``members`` has rep, n, prefix, component, component_size and grp. Of two components the smaller one asks
    (the smaller number, if equally large), so the sets of a large one never meet each other. Where the
    first shingle that two linked sets share stands, both must have as many shingles left as a link takes;
    a row of the matrix holds the most that any member has left, and other rows are not asked.
    """
    rank = F.struct("component_size", "component")
    tokens = members.withColumn("rank", rank).select("rep", "n", "grp", "rank", "component", F.posexplode("prefix").alias("at", "token"))
    tokens = tokens.withColumn("rest", F.col("n") - F.col("at")).drop("at")
    live = staged(
        tokens.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where(F.col("low") != F.col("high")).select("token"),
        "live",
    )
    few = live.count() <= MAX_BROADCAST
    shared = staged(tokens.join(F.broadcast(live) if few else live, "token"), "shared")
    top = shared.groupBy("token").agg(F.max("rank").alias("top"))
    matrix = (
        shared.groupBy("token", "grp", "rank").agg(F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.max("rest").alias("grp_rest"))
        .withColumnRenamed("rank", "grp_rank")
    )
    asking = staged(shared.join(top, "token").where(F.col("rank") < F.col("top")).select("token", "rep", "n", "rank", "rest"), "asking")
    # A set with fewer such shingles in all than a link to the group's sizes takes need not ask that group.
    asking = asking.join(asking.groupBy("rep").agg(F.count("*").alias("asks")), "rep")
    n, low, high = F.col("n"), F.col("n_low"), F.col("n_high")
    smallest = F.greatest(low, -F.floor(-n * num / den + 1e-9))
    opened = staged(
        asking.join(
            matrix,
            (asking["token"] == matrix["token"]) & (F.col("rank") < F.col("grp_rank")) & (high * den >= n * num) & (n * den >= low * num)
            & (F.least("rest", "grp_rest") >= least_overlap(n, smallest, num, den))
            & (F.col("asks") >= least_needed(n, low, high, num, den)),
        ).select(F.col("rep").alias("query"), "grp").distinct(),
        "opened",
    )
    inside = (
        members.join(opened.select("grp").distinct(), "grp", "left_semi").groupBy("grp")
        .agg(F.collect_list(F.struct("rep", "n", "prefix", "marks")).alias("inside"))  # about GROUP members
    )
    asks = members.select(F.col("rep").alias("query"), F.col("n").alias("query_n"), F.col("prefix").alias("query_prefix"), F.col("marks").alias("query_marks"))
    # Members are compared within the row of the query and the group.
    room = lambda m: F.when(
        _sizes_fit(m["n"], F.col("query_n"), num, den) & _marks_fit(m["marks"], F.col("query_marks"), m["n"], F.col("query_n"), num, den),
        F.size(F.array_intersect(m["prefix"], F.col("query_prefix"))) - needed(m["n"], F.col("query_n"), num, den),
    ).otherwise(F.lit(-1).cast("long"))
    compared = F.transform("inside", lambda m: F.struct(room(m).alias("room"), m["rep"].alias("rep")))
    possible = F.transform(F.sort_array(F.filter(compared, lambda m: m["room"] >= 0), asc=False), lambda m: m["rep"])
    found = opened.join(inside, "grp").join(asks, "query").select("query", "grp", possible.alias("possible"))
    return staged(found, "possible").where(F.size("possible") > 0)


def _ordered_pair(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _still_apart(possible: DataFrame, members: DataFrame, components: DataFrame) -> DataFrame:
    """The possible links, but the likeliest of each row, of sets that are not in one component by now.

    A row whose query and group are in one component is dropped before its links become rows.
    """
    now = staged(
        members.select("rep", "grp").join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select("rep", "grp", F.coalesce("component", "rep").alias("own")),
        "now",
    )
    spans = now.groupBy("grp").agg(F.min("own").alias("low"), F.max("own").alias("high"))
    apart = (
        possible.where(F.size("possible") > 1).join(spans, "grp")
        .join(now.select(F.col("rep").alias("query"), F.col("own").alias("query_own")), "query")
        .where((F.col("low") != F.col("query_own")) | (F.col("high") != F.col("query_own")))
        .select("query", "query_own", F.explode(F.slice("possible", F.lit(2), F.size("possible"))).alias("rep"))
    )
    return apart.join(now, "rep").where(F.col("own") != F.col("query_own")).select(*_ordered_pair("query", "rep")).distinct()


def ngram_jaccard_join(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (8, 10)) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of ``similarity`` (a fraction) or more.

    Returns per row doc_id, n_shingles and component_id, the smallest doc_id reachable by links. Texts with
    fewer than ``words`` words are one shingle; null texts and texts without words have none and are linked
    with nothing. Rows with equal sets are linked. Texts that share a doc_id are compared each by itself; a
    row without doc_id belongs to the component of the rows with its set, null if these have no doc_id
    either. An empty table gives an empty result. Columns besides doc_id and text are ignored.
    """
    linked = linked_rows(docs, words, similarity)
    return linked.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def linked_rows(docs: DataFrame, words: int, similarity: tuple[int, int], unnamed: bool = False) -> DataFrame:
    """(doc_id, hash, n_shingles, component, component_id) of every row; ``hash`` is xxhash64 of the text.

    ``component`` is a number of the row's component that tells apart texts that share a doc_id, null for
    texts without words; ``component_id`` is the smallest doc_id in it. Sets that only rows without doc_id
    have take part if ``unnamed``; else they have no component.
    """
    num, den = similarity
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    levels = spark.sparkContext.broadcast(shingle_levels(rows, words))
    sets = staged(shingle_sets(rows, words, levels, num, den), "sets")
    key = ["key1", "key2"]
    # A class goes by the hash of one of its texts: other classes have other texts, whatever their doc_ids.
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash", "n", "low1", "low2", "prefix", "marks")).alias("x")
    classes = staged(
        sets.where((F.col("n") > 0) & (F.col("doc_id").isNotNull() | F.lit(unnamed))).groupBy(*key).agg(one)
        .select(*key, F.col("x.hash").alias("rep"), "x.doc_id", "x.n", "x.low1", "x.low2", "x.prefix", "x.marks"),
        "classes",
    )
    near = verified(_pivot_pairs(classes, num, den), classes, rows, words, num, den)
    first = connected_components(near)
    placed = staged(_grouped(classes, first), "placed")
    members = _by_group(placed)
    possible = _matrix_links(members, num, den)
    # A link joins whole components, so that of a set with a group the likeliest is verified first.
    likeliest = possible.select("query", F.col("possible")[0].alias("rep")).select(*_ordered_pair("query", "rep"))
    links = near.union(verified(likeliest.union(_pairs_within(members, num, den)).distinct(), classes, rows, words, num, den))
    last = connected_components(links)
    rest = staged(_still_apart(possible, members, last), "rest")
    if not rest.isEmpty():
        last = connected_components(links.union(verified(rest, classes, rows, words, num, den)))
    last = last.withColumnRenamed("node", "rep")
    least = last.join(classes.select("rep", "doc_id"), "rep").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = classes.select(*key, "rep", "doc_id").join(last.join(least, "component"), "rep", "left").select(
        *key, F.coalesce("component", "rep").alias("component"), F.coalesce("least", "doc_id").alias("component_id")
    )
    return sets.select("doc_id", "hash", F.col("n").cast("long").alias("n_shingles"), *key).join(named, key, "left").select(
        "doc_id", "hash", "n_shingles", "component", "component_id"
    )
