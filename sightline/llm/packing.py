"""Best-fit packing of tokenised documents, planned over the histogram of lengths.

The plan depends only on how many pieces there are of each length (at most ``capacity`` numbers), so it
is made on the driver in a moment whatever the corpus size. Pieces then take the planned slots by their
rank within their length; ranks come from one sort by length over range partitions, so a length that a
third of all pieces share is still dealt over many tasks.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import parted, pick, positioned, staged

#: Characters of a word, or white space beyond one a word, from which on a text goes to the slow library.
LONG_RUN = 1_000


def _byte_symbols() -> dict[str, int]:
    """The printable characters that a byte-level vocabulary writes for bytes."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(other)}


class _Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    Most texts are encoded by ``tiktoken`` from the file's vocabulary, whose ids are the ranks of its
    merges; it gives the ids of ``tokenizers`` in a quarter of the time. Texts that may hold special
    tokens, or runs long enough to make it slow, go to ``tokenizers``, which is loaded for the first such
    text, so that most workers hold one vocabulary.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        self.marks = tuple(t["content"] for t in stated["added_tokens"])
        byte = _byte_symbols()
        ranks = {bytes(byte[c] for c in t): i for t, i in stated["model"]["vocab"].items() if t not in self.marks}
        del stated
        self.fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.fast._mergeable_ranks = {}  # the encoder has its own copy

    @cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _plain(self, text: str) -> bool:
        if any(mark in text for mark in self.marks):
            return False
        words = text.split()
        return max(map(len, words), default=0) < LONG_RUN and len(text) - sum(map(len, words)) < len(words) + LONG_RUN

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if self._plain(text):
                yield np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()
            else:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


#: Workers keep their encoder from task to task.
_ENCODERS: dict[str, _Encoder] = {}


def encoder_of(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 2) -> DataFrame:
    """One row per piece of at most ``capacity`` ids; only the first of several may be shorter."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        pa.default_memory_pool().release_unused()  # a worker serves several stages
        for batch in (part for whole in batches for part in parted(whole)):
            out: list[list] = [[], [], [], [], []]
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.batch(texts)):
                ids += end
                total = len(ids) // 4
                stop = total % capacity or capacity
                start = 0
                for piece in range(-(-total // capacity)):
                    part = memoryview(ids)[4 * start : 4 * stop]
                    for column, value in zip(out, (doc, piece, start, stop - start, zlib.crc32(part))):
                        column.append(value)
                    start, stop = stop, stop + capacity
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(out, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(pieces, PIECES)


def best_fit_plan(histogram: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int]]]:
    """Per length the runs ``(first rank, first sequence, offset)``, by first rank.

    Best-fit decreasing over counts: all pieces of one length are placed at once. A group is a range of
    equally filled sequences; the fullest group that still has room takes as many pieces per sequence as
    fit, exactly as piece-by-piece best fit would, because a sequence that got a piece stays the fullest.
    A run covers consecutive ranks that go to consecutive sequences at the same offset.
    """
    rooms: list[int] = []  # sorted free lengths that occur
    groups: dict[int, list[tuple[int, int]]] = {}  # free length: (first sequence, sequences)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left, rank, mine = histogram[length], 0, []
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room = capacity
                first, n = used, -(-left // (capacity // length))
                used += n
            each = room // length
            full = min(n, left // each)
            if full:
                for slot in range(each):
                    mine.append((rank, first, capacity - room + slot * length))
                    rank += full
                left -= full * each
                put(room - each * length, first, full)
                first, n = first + full, n - full
            if n and left and left < each:
                for slot in range(left):
                    mine.append((rank, first, capacity - room + slot * length))
                    rank += 1
                put(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            put(room, first, n)
        runs[length] = mine
    return runs


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give every piece ``sequence_id`` and ``offset``; sequences are filled from 0 without gaps.

    ``pieces`` needs doc_id, piece, start, length and ``row``, a number of its own for every row, and is
    read twice, so pass a written table. A piece's rank within its length is its position in the order by
    length less the pieces that are shorter; the runs of its length say where that rank goes.
    """
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit_plan(counted, capacity)
    shorter, rows = 0, []
    for length in sorted(plan):
        rows.append((length, shorter, plan[length]))
        shorter += counted[length]
    # A row per length, at most ``capacity``; the runs of all lengths do not grow with the corpus.
    runs = pieces.sparkSession.createDataFrame(rows, "length int, shorter long, runs array<struct<rank:long,first:long,place:int>>")
    placed = (
        positioned(pieces, F.col("length"), F.col("doc_id"), F.col("piece"), F.col("start"), F.col("row"))
        .join(F.broadcast(runs), "length")
        .withColumn("rank", F.col("position") - F.col("shorter"))
        .withColumn("run", F.element_at(F.filter("runs", lambda r: r["rank"] <= F.col("rank")), -1))
    )
    return placed.select(
        *[n for n in pieces.columns if n != "row"],
        (F.col("run.first") + F.col("rank") - F.col("run.rank")).alias("sequence_id"),
        F.col("run.place").cast("long").alias("offset"),
    )


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as best fit finds.

    A document is the ids of its text followed by ``end_id``; a null or empty text is that id alone.
    Longer documents are cut into pieces of ``capacity``, the first of which may be shorter. Returns per
    piece doc_id, piece, start, length, ids_crc32, sequence_id and offset. Repeated rows and rows without
    doc_id are packed like others, each by itself; an empty table gives an empty result.
    """
    pieces = token_pieces(docs, tokenizer, capacity, end_id).withColumn("row", F.monotonically_increasing_id())
    return pack(staged(pieces, "pieces"), capacity)
