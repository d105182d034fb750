"""Line deduplication by a segment-partition edit join.

A line is cut into ``max_edits`` + 1 segments. Two lines within ``max_edits`` edits share, by the pigeonhole
principle, a whole segment of the shorter one, at nearly the same place. Segments are indexed by number,
line length and content; the longer line probes them with the few substrings that can match, and lines
that meet are verified by a banded bit-parallel edit distance. Of every class of linked lines the first
occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import mixed, pick, shuffle_tasks, staged
from sightline.llm.components import connected_components

#: Lines of a hot signature that meet in one tile, rows to broadcast at most, characters worked on at once.
TILE, MAX_BROADCAST, AT_ONCE = 256, 1_000_000, 1_000_000
_SEED = 42  # the seed of the built-in xxhash64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def within_edits(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance of a and b is at most ``limit``.

    Equal ends are set aside. The rest is computed column by column with the vertical differences of the
    2 * limit + 1 rows around the diagonal as bits of one number; it stops once the limit is out of reach.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > limit:
        return False
    if a == b:
        return True
    start = _common(a, b, len(a))
    a, b = a[start:], b[start:]
    end = _common(a[::-1], b[::-1], len(a))
    a, b = a[: len(a) - end], b[: len(b) - end]
    n, m = len(a), len(b)
    if n <= limit:
        return _small(a, b) <= limit
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    # Bit t of column j stands for row j + limit - (top - t): the top bit is the lowest row of the band.
    top = 2 * limit + 1
    every = (1 << (top + 1)) - 1
    lowest = 1 << top
    plus, minus = every & ~((1 << (top - limit)) - 1), 0
    score, bit = limit, lowest
    for j in range(1, m + 1):
        match = where.get(b[j - 1], 0)
        shift = j + limit - top - 1
        match = (match >> shift if shift >= 0 else match << -shift) & every
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & every
        right_plus = (minus | ~(diagonal | plus)) & every
        right_minus = diagonal & plus
        if j <= n - limit:  # the followed cell moves along the lower edge of the band
            score += not diagonal & lowest
        else:  # and then along the last row
            bit >>= 1
            score += bool(right_plus & bit) - bool(right_minus & bit)
        # The cell can still lose one for each column left in the last row.
        if score > limit + (m - max(j, n - limit)):
            return False
        down = diagonal >> 1
        plus = (right_minus | ~(down | right_plus)) & every
        minus = down & right_plus
    return score <= limit


def _common(a: str, b: str, most: int) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _small(a: str, b: str) -> int:
    row = list(range(len(a) + 1))
    for j, c in enumerate(b, 1):
        before, row[0] = row[0], j
        for i, d in enumerate(a, 1):
            before, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, before + (c != d))
    return row[-1]


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, end) of nearly equal segments; the last ones take the rest."""
    short, rest = divmod(length, parts)
    out, start = [], 0
    for i in range(parts):
        end = start + short + (i >= parts - rest)
        out.append((start, end))
        start = end
    return out


def probe_plan(length: int, limit: int) -> list[tuple[int, int, int, bool]]:
    """(seed, start, end, indexed) of the substrings of a line that stand in the index or probe it.

    The index holds a line's own segments. A line probes for lines that are 0 to ``limit`` shorter: a
    segment i (from 0) that matches first after at most i edits starts within i of its place, and counted
    from the end within limit - i. Unshifted probes for equally long lines are the segments themselves.
    """
    plan = []
    for less in range(limit + 1):
        other = length - less
        if other < limit + 1:
            continue
        for i, (start, end) in enumerate(segments(other, limit + 1)):
            low, high = max(-i, less - (limit - i)), min(i, less + (limit - i))
            for shift in range(low, high + 1):
                at = start + shift
                if at < 0 or at + end - start > length:
                    continue
                plan.append((other * (limit + 1) + i, at, at + end - start, not less and not shift))
    return plan


def _bags(points: np.ndarray, owner: np.ndarray, lines: int) -> np.ndarray:
    """Per line the counts of 16 classes of code points, modulo 16, in the 16 halves of the bytes of a 64-bit number."""
    counts = np.bincount(owner * 16 + (points & 15), minlength=16 * lines).reshape(-1, 16) & 15
    return (counts.astype(np.uint64) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)


def bags_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of how many characters must be added to or taken from one line to get the other."""
    total = np.zeros(len(a), dtype=np.int64)
    for i in range(16):
        off = ((a >> np.uint64(4 * i)) - (b >> np.uint64(4 * i))) & np.uint64(15)
        total += np.minimum(off, np.uint64(16) - off).astype(np.int64)
    return total


class LineSignatures:
    """Signatures of the substrings of many lines at once.

    A running sum of code points times powers of an odd number gives the hash of any substring as a
    difference, divided by the power at its start (modulo 2**64). Equal substrings have equal hashes; others
    that collide only cost a verification.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.plans: dict[int, np.ndarray] = {}
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)

    def _plan(self, length: int) -> np.ndarray:
        """Rows of seed, start, end and indexed; a line without segments, up to ``limit`` long, has none."""
        if (plan := self.plans.get(length)) is None:
            if len(self.plans) > 5000:
                self.plans.clear()
            plan = self.plans[length] = np.array(probe_plan(length, self.limit), dtype=np.int64).reshape(-1, 4).T
        return plan

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            one = np.ones(1, dtype=np.uint64)
            self.powers = np.concatenate([one, np.cumprod(np.full(n, _BASE))])
            self.inverse = np.concatenate([one, np.cumprod(np.full(n, _INVERSE))])

    def __call__(self, lines: list[str], names: list[int]) -> pa.RecordBatch:
        length = np.array([len(x) for x in lines], dtype=np.int64)
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        bags = _bags(points, np.repeat(np.arange(len(lines)), length), len(lines))
        self._grow(len(points) + 1)
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(mixed(points.astype(np.uint64) + _BASE) * self.powers[: len(points)], out=sums[1:])
        begin = np.cumsum(length) - length
        different, which = np.unique(length, return_inverse=True)
        plans = [self._plan(int(x)) for x in different]
        rows = np.array([x.shape[1] for x in plans], dtype=np.int64)
        seed, start, end, indexed = np.concatenate(plans, axis=1) if plans else np.zeros((4, 0), dtype=np.int64)
        # The plan rows of a line's length follow each other in the joined plans.
        mine = rows[which]
        row = np.repeat(np.arange(len(lines)), mine)
        at = np.arange(len(row)) + np.repeat((np.cumsum(rows) - rows)[which] - (np.cumsum(mine) - mine), mine)
        first, last = begin[row] + start[at], begin[row] + end[at]
        sig = mixed(((sums[last] - sums[first]) * self.inverse[first]) ^ mixed(seed.astype(np.uint64) + _BASE)[at])
        line = np.array(names, dtype=np.uint64)
        return pa.RecordBatch.from_arrays(
            [pa.array(sig.view(np.int64)), pa.array(line[row].view(np.int64)), pa.array(indexed[at] == 1), pa.array(bags[row].view(np.int64))],
            names=["sig", "line", "indexed", "bag"],
        )


def _signatures(docs: DataFrame, limit: int, min_chars: int) -> DataFrame:
    """(sig, line, indexed, bag) of the different lines of each batch of texts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = LineSignatures(limit)
        for batch in batches:
            seen: set[int] = set()
            lines: list[str] = []
            names: list[int] = []
            size = 0
            for text in batch.column("text"):
                for line in (text.as_py() or "").split("\n"):
                    if len(line) < min_chars:
                        continue
                    name = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), _SEED)
                    if name in seen:
                        continue
                    seen.add(name)
                    lines.append(line)
                    names.append(name)
                    size += len(line)
                    if size >= AT_ONCE:
                        yield signatures(lines, names)
                        lines, names, size = [], [], 0
            yield signatures(lines, names)

    return docs.mapInArrow(emit, "sig long, line long, indexed boolean, bag long")


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that never split a run of equal keys, from batches sorted by them."""
    kept: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table])
        if not table.num_rows:
            kept = table
            continue
        last = np.ones(table.num_rows, dtype=bool)
        for key in keys:
            column = table.column(key).to_numpy()
            last &= column == column[-1]
        cut = table.num_rows - (int(np.argmin(last[::-1])) if not last.all() else table.num_rows)
        if cut:
            yield table.slice(0, cut)
        kept = table.slice(cut).combine_chunks()
    if kept is not None and kept.num_rows:
        yield kept


def run_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for key in keys:
        column = table.column(key).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


_TILE = ["sig", "left", "right"]


def _in_tiles(members: DataFrame, tile: int) -> DataFrame:
    """Deal the lines of each signature over tiles so that every two of them meet in one.

    Lines fall into blocks of about ``tile`` lines; a tile is a pair of blocks. A signature with one block
    has one tile; with k blocks a line goes to k tiles.
    """
    blocks = members.groupBy("sig").agg(F.ceil(F.count("*") / tile).alias("blocks")).where("blocks > 1")
    dealt = members.join(blocks, "sig", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("line"), "blocks")
    return (
        dealt.withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("left", F.least("mine", "other")).withColumn("right", F.greatest("mine", "other"))
        .drop("mine", "other", "blocks")
    )


def _meeting(members: DataFrame, limit: int) -> DataFrame:
    """The lines of each tile that have a possible partner there: one of the two must be indexed."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, _TILE):
            starts = run_starts(table, _TILE)
            size = np.diff(starts)
            line, bag = table.column("line").to_numpy(), table.column("bag").to_numpy().view(np.uint64)
            indexed = table.column("indexed").to_numpy(zero_copy_only=False).astype(bool)
            good = np.zeros(table.num_rows, dtype=bool)
            # Every row against the row ``step`` places on in its run; a run has few rows.
            rest = np.repeat(starts[1:], size) - np.arange(table.num_rows) - 1
            for step in range(1, int(size.max(initial=0))):
                a = np.flatnonzero(rest >= step)
                b = a + step
                ok = (line[a] != line[b]) & (indexed[a] | indexed[b])
                a, b = a[ok], b[ok]
                ok = bags_apart(bag[a], bag[b]) <= 2 * limit  # a replacement takes one and adds one
                good[a[ok]] = True
                good[b[ok]] = True
            kept = table.filter(pa.array(good)).combine_chunks()
            yield from kept.to_batches()

    fields = "sig long, line long, indexed boolean, left long, right long, bag long"
    names = ["sig", "line", "indexed", "left", "right", "bag"]
    tiled = members.select(*names).repartition(shuffle_tasks(members.sparkSession), *_TILE).sortWithinPartitions(*_TILE, "line")
    return tiled.mapInArrow(meet, fields)


def _linked(meeting: DataFrame, limit: int) -> DataFrame:
    """Edges between lines within the limit, from tiles with texts; a forest per tile, no pair twice."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, _TILE):
            starts = run_starts(table, _TILE)
            texts, indexed = table.column("text").to_pylist(), table.column("indexed").to_pylist()
            edges: list[tuple[int, int]] = []
            for first, end in zip(starts[:-1], starts[1:]):
                root = list(range(end - first))

                def top(i: int, root=root) -> int:
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                for i in range(1, end - first):
                    for j in range(i):
                        if not (indexed[first + i] or indexed[first + j]) or top(i) == top(j):
                            continue
                        if within_edits(texts[first + i], texts[first + j], limit):
                            root[top(i)] = top(j)
                            edges.append((first + i, first + j))
            a, b = (pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [table.column(c).combine_chunks().take(x) for x, c in ((a, "key"), (b, "key"))], names=["a", "b"]
            )

    tiled = meeting.repartition(shuffle_tasks(meeting.sparkSession), *_TILE).sortWithinPartitions(*_TILE, "line", "text")
    return tiled.select(*_TILE, "indexed", "text", "key").mapInArrow(verify, "a struct<h:long,g:long>, b struct<h:long,g:long>")


def line_key(line: Column) -> Column:
    """128 bits that name a line."""
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g"))


def _lines(docs: DataFrame, min_chars: int, *columns: str) -> DataFrame:
    rows = docs.select(*columns, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return rows.where(F.char_length("line") >= min_chars)


def repeated_lines(docs: DataFrame, max_edits: int = 2, min_chars: int = 40) -> DataFrame:
    """(doc_id, hash, line_no) of the lines that repeat an earlier one, exactly or within ``max_edits`` edits.

    ``hash`` is xxhash64 of the text. The earliest line is that of the smallest doc_id, hash and number;
    rows without doc_id come last.
    """
    rows = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("hash"), "text")
    signatures = _signatures(rows.select("text"), max_edits, min_chars)
    live = staged(
        signatures.groupBy("sig").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.max("indexed").alias("indexed"))
        .where((F.col("low") != F.col("high")) & F.col("indexed")).select("sig"),
        "live",
    )
    few = live.count() <= MAX_BROADCAST
    members = staged(
        signatures.join(F.broadcast(live) if few else live, "sig").groupBy("sig", "line")
        .agg(F.max("indexed").alias("indexed"), F.min("bag").alias("bag")),
        "members",
    )
    meeting = staged(_meeting(_in_tiles(members, TILE), max_edits).drop("bag"), "meeting")
    wanted = staged(meeting.select("line").distinct(), "wanted")
    few = wanted.count() <= MAX_BROADCAST
    texts = staged(
        _lines(rows, min_chars).select(line_key(F.col("line")).alias("key"), F.col("line").alias("text"))
        .withColumn("line", F.col("key.h"))
        .join(F.broadcast(wanted) if few else wanted, "line").groupBy("line", "key").agg(F.min("text").alias("text")),
        "texts",
    )
    edges = staged(_linked(meeting.join(texts, "line"), max_edits).distinct(), "links")
    classes = connected_components(edges)

    found = _lines(rows, min_chars, "doc_id", "hash").select("doc_id", "hash", "line_no", line_key(F.col("line")).alias("key"))
    classed = staged(found, "lines").join(classes.withColumnRenamed("node", "key"), "key", "left").select(
        "doc_id", "hash", "line_no", F.coalesce("component", "key").alias("class")
    )
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash", "line_no")
    first = classed.groupBy("class").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return classed.join(first, "class").where(place != F.col("first")).select("doc_id", "hash", "line_no")


def with_removed(docs: DataFrame, max_edits: int = 2, min_chars: int = 40) -> DataFrame:
    """``docs`` (which needs doc_id and text) with ``removed``, the sorted numbers of its repeated lines."""
    gone = (
        repeated_lines(docs, max_edits, min_chars).groupBy(F.col("doc_id").alias("_gone_id"), F.col("hash").alias("_gone_hash"))
        .agg(F.array_sort(F.collect_set("line_no")).alias("_removed"))
    )
    # The hash is a column of its own, so that texts travel only for a caller who takes them.
    hashed = docs.withColumn("_text_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.col("_text_hash") == F.col("_gone_hash"))
    removed = F.coalesce("_removed", F.array().cast("array<int>")).alias("removed")
    return hashed.join(gone, same, "left").select(*docs.columns, removed)


def dedup_lines(docs: DataFrame, max_edits: int = 2, min_chars: int = 40) -> DataFrame:
    """Every row's lines to leave out: ``removed``, the sorted numbers (from 0) of its repeated lines.

    Lines of at least ``min_chars`` characters are linked when equal or within ``max_edits`` edits
    (characters added, dropped or replaced); of all lines reachable by links the first stays, by doc_id and
    line number, rows without doc_id last. Shorter lines always stay. Returns doc_id, text, n_lines and
    removed. A null text has no lines, an empty one has one empty line. Rows that repeat both doc_id and
    text count as one. An empty table gives an empty result. Columns besides doc_id and text are ignored.
    """
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    rows = pick(docs, "doc_id", "text").withColumn("n_lines", n_lines)
    return with_removed(rows, max_edits, min_chars).select("doc_id", "text", "n_lines", "removed")


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines of the given numbers."""
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(removed, i))
    return F.when(F.size(removed) == 0, text).otherwise(F.array_join(kept, "\n"))
