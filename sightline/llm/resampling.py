"""Target-distribution importance resampling with bit-sliced sums.

A text's features are hashed to buckets; the bits of its bucket counts are stored as planes of one bit a
bucket. What a bucket gains for a text is a signed whole number, stored as planes too, one set for positive
and one for negative gains. A text's weight is then a sum of powers of two times the bits that a count
plane and a gain plane have in common: exact whole-number arithmetic without multiplying any count.
Documents are drawn without replacement by weight plus Gumbel noise from a seeded hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import pick, positioned, staged

#: Lower-case A-Z; ASCII besides digits and letters parts words, all else belongs to them.
_CLEAN = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
#: Texts whose planes are held at once.
AT_ONCE = 256


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_CLEAN).split()


def bucket_counts(words: list[bytes], buckets: int) -> np.ndarray:
    """How often the single words and the pairs of neighbours fall in each bucket."""
    if not words:
        return np.zeros(buckets, dtype=np.int64)
    single = list(map(crc32, words))
    pairs = [crc32(b" " + b, a) for a, b in zip(single, words[1:])]  # goes on from the first word's sum
    return np.bincount(np.array(single + pairs, dtype=np.int64) % buckets, minlength=buckets)


def plane_bytes(buckets: int) -> int:
    """Bytes of a plane: one bit a bucket, in whole 64-bit words."""
    return -(-buckets // 64) * 8


def planes_of(counts: np.ndarray, buckets: int) -> bytes:
    """The planes of whole numbers, lowest bit first; none if all are 0."""
    width = plane_bytes(buckets)
    out = bytearray()
    for bit in range(int(counts.max(initial=0)).bit_length()):
        out += np.packbits((counts >> bit & 1).astype(np.uint8)).tobytes().ljust(width, b"\0")
    return bytes(out)


def _plane_rows(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All planes of a batch as rows of 64-bit words, with the text each belongs to and its bit number."""
    held = column.to_pylist()
    width = plane_bytes(buckets)
    sizes = np.array([len(x) // width for x in held], dtype=np.int64)
    owner = np.repeat(np.arange(len(held)), sizes)
    bit = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.frombuffer(b"".join(held), dtype=np.uint64).reshape(-1, width // 8), owner, bit


PLANES = "doc_id long, n_words long, n_features long, planes binary"


def feature_planes(docs: DataFrame, buckets: int) -> DataFrame:
    """Per row doc_id, n_words, n_features and the planes of its bucket counts."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                n_words, planes = [], []
                for data in part.column("text").cast(pa.binary()).to_pylist():
                    words = words_of(data or b"")
                    n_words.append(len(words))
                    planes.append(planes_of(bucket_counts(words, buckets), buckets))
                features = [max(0, 2 * n - 1) for n in n_words]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(features, pa.int64()), pa.array(planes, pa.binary())],
                    names=["doc_id", "n_words", "n_features", "planes"],
                )

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(describe, PLANES)


def bucket_totals(planes: DataFrame, buckets: int) -> np.ndarray:
    """Features of all texts per bucket; every task adds up its planes before they are shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                rows, _, bit = _plane_rows(batch.column("planes").slice(start, AT_ONCE), buckets)
                for b in np.unique(bit):
                    bits = np.unpackbits(np.ascontiguousarray(rows[bit == b]).view(np.uint8), axis=1, count=buckets)
                    total += bits.sum(axis=0, dtype=np.int64) << int(b)
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), pa.array(total[kept])], names=["bucket", "n"])

    totals = np.zeros(buckets, dtype=np.int64)
    summed = planes.select("planes").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in summed.collect():  # at most ``buckets`` rows
        totals[row["bucket"]] = row["n"]
    return totals


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in the target over that in the source) per bucket."""
    buckets, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log(((t + 1) * (all_s + buckets)) / ((s + 1) * (all_t + buckets))))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        dtype=np.int64,
    )


def bit_sliced_sums(column: pa.Array, gains: np.ndarray) -> np.ndarray:
    """Per text the sum over buckets of count times gain, from the planes of both."""
    buckets = len(gains)
    rows, owner, bit = _plane_rows(column, buckets)
    sums = np.zeros(len(column), dtype=np.int64)
    for sign, part in ((1, np.maximum(gains, 0)), (-1, np.maximum(-gains, 0))):
        for j, plane in enumerate(np.frombuffer(planes_of(part, buckets), dtype=np.uint64).reshape(-1, rows.shape[1])):
            common = np.bitwise_count(rows & plane).sum(axis=1, dtype=np.int64)
            np.add.at(sums, owner, sign * (common << (bit + j)))
    return sums


def weighed(planes: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of the text's features, 0 without any."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                n = part.column("n_features").to_numpy(zero_copy_only=False)
                weight = bit_sliced_sums(part.column("planes"), gains) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(x) for x in ("doc_id", "n_words", "n_features")], pa.array(weight)],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    return planes.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def _noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise, a whole number, from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    share: tuple[int, int] = (25, 100),
    least_words: int = 20,
    buckets: int = 10_000,
    seed: int = 7,
) -> DataFrame:
    """Draw ``share`` of the documents of at least ``least_words`` words towards the target's texts.

    Returns per row doc_id, n_words, n_features, weight, score and rank (from 1 in the order of drawing;
    null if not drawn). Null and empty texts have no features and weight 0. Rows without doc_id draw the
    noise of an empty id and come after others of equal score; repeated rows take part each by itself and
    equal ones are ranked one after another. Without target texts all buckets count as equally likely. An
    empty table gives an empty result. Columns besides doc_id and text (text of ``target``) are ignored.
    """
    of_docs = staged(feature_planes(docs, buckets), "planes")
    goal = feature_planes(pick(target, "text").withColumn("doc_id", F.lit(None).cast("long")), buckets)
    gains = bucket_gains(bucket_totals(of_docs, buckets), bucket_totals(goal, buckets))
    enough = F.col("n_words") >= least_words
    scored = staged(
        weighed(of_docs, gains)
        .withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))
        .withColumn("row", F.monotonically_increasing_id()),
        "scores",
    )
    drawn = scored.where(enough).count() * share[0] // share[1]
    ranked = positioned(scored, F.when(enough, F.lit(0)).otherwise(F.lit(1)), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row"))
    rank = F.col("position") + 1
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(enough & (rank <= drawn), rank).alias("rank"))
