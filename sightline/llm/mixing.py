"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets per source become whole numbers of blocks by highest quotients, first over the sources and then
over the hash shards of each source; no shard gets more than ``cap`` times its words. What whole blocks
cannot express of a source's target is dealt in words. Inside a shard the documents lie one after another
in seeded order and are cut into blocks of equally many words; a seeded permutation of the block numbers
says which blocks the shard's quota takes, the last one in part. A quota beyond the shard's words takes
every block once and the permuted first ones a second time.
"""

from __future__ import annotations

import heapq
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.common import WORD, pick, staged, word_count

#: A multiplier for block numbers that shares no factor with fewer blocks than itself.
PRIME = 2_147_483_647


def capped_targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Share ``total`` by weight; no share above ``cap`` times its size, the excess reshared by weight."""
    targets = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        for i in full:
            targets[i] = cap * sizes[i]
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients votes / (2k + 1); equal quotients go to the earlier party."""
    whole = sum(votes)
    if not whole:
        return [0] * len(votes)
    # All but a few seats of each party are certain; the last ones are dealt one by one.
    got = [max(0, math.floor(v / whole * seats) - 2) for v in votes]
    heap = [(-v / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes, got)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def _shard_quotas(shards: DataFrame, block_words: int, cap: float) -> DataFrame:
    """Split each source's blocks over its shards by highest quotients of the shard sizes, then its words.

    A shard surely gets its proportional seats less two (none if that is below none); only the few
    quotients after these compete, and only up to ``cap`` times the shard's words. The words that are left
    of the source's ``words`` fill up shards in the order of their numbers. Returns ``quota``, in words.
    """
    share = F.col("blocks") * F.col("shard_size") / F.col("source_size")
    sure = F.greatest(F.lit(0), F.floor(share) - 2).cast("long")
    most = F.floor(F.col("shard_size") * F.lit(float(cap))).cast("long")
    open_ = shards.withColumn("sure", F.when(F.col("source_size") > 0, sure).otherwise(F.lit(0))).withColumn("most", most)
    by_source = Window.partitionBy("source_no")
    places = open_.withColumn("left", F.col("blocks") - F.sum("sure").over(by_source)).withColumn(
        "k", F.explode(F.sequence(F.lit(0), F.lit(6)))
    )
    fits = (F.col("sure") + F.col("k") + 1) * block_words <= F.col("most")
    quotient = F.when(fits, F.col("shard_size") / (2 * (F.col("sure") + F.col("k")) + 1))
    best = by_source.orderBy(F.desc_nulls_last("quotient"), "shard", "k")
    won = F.col("quotient").isNotNull() & (F.col("place") <= F.col("left"))
    seats = (
        places.withColumn("quotient", quotient).withColumn("place", F.row_number().over(best))
        .groupBy("source_no", "shard", "shard_size", "most", "words")
        .agg(((F.first("sure") + F.sum(won.cast("long"))) * block_words).alias("seated"))
    )
    spare = F.col("most") - F.col("seated")
    before = F.coalesce(F.sum(spare).over(by_source.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.col("words") - F.sum("seated").over(by_source)
    return seats.select(
        "source_no", "shard", "shard_size",
        (F.col("seated") + F.greatest(F.lit(0), F.least(spare, rest - before))).cast("long").alias("quota"),
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    block_words: int = 64,
    shard_docs: int = 256,
    max_sources: int = 100_000,
    seed: int = 17,
) -> DataFrame:
    """Words that a weighted mix takes of every document, with the spans they lie in.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all
    words; no source gives more than ``cap`` (at most 2) times its words and no document more than twice its
    own. A source gives its target rounded to whole words. Returns per row doc_id, source, hash (xxhash64
    of the text), size, source_size, target, taken and ``spans``: (start word, end word, times) of the
    taken blocks. A source has as many shards as its documents by ``shard_docs`` or, if that is less, by
    the root of their number, so that shards and documents of a shard grow alike.
    ``max_sources`` bounds what the driver holds; more sources raise ValueError. Null texts have size 0
    and give nothing. Repeated rows count each by itself; rows without doc_id or source are mixed like
    others. An empty table gives an empty result. Columns besides doc_id, text and source are ignored.
    """
    sized = staged(
        pick(docs, "doc_id", "source", "text").select(
            "doc_id", "source", F.xxhash64("text").alias("hash"), word_count(F.col("text")).alias("size")
        ),
        "sizes",
    )
    spans_type = "array<struct<start:long,end:long,times:long>>"
    per_source = (
        sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
        .limit(max_sources + 1).collect()
    )
    if len(per_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    if not per_source:
        return sized.select(
            "doc_id", "source", "hash", "size", F.lit(0).cast("long").alias("source_size"),
            F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"),
            F.lit(None).cast(spans_type).alias("spans"),
        )
    order = sorted(per_source, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in order]
    total = share * sum(sizes)
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(order))], total, cap)
    words = [min(round(t), math.floor(cap * n)) for t, n in zip(targets, sizes)]
    # A block that would go beyond the target is dealt in words instead.
    seats = [min(q, w // block_words) for q, w in zip(sainte_lague(targets, round(total / block_words)), words)]
    plan = sized.sparkSession.createDataFrame(
        [
            (i, r["source"], r["size"], t, w, q, -(-r["docs"] // max(shard_docs, math.isqrt(r["docs"]))))
            for i, (r, t, w, q) in enumerate(zip(order, targets, words, seats))
        ],
        "source_no int, plan_source string, source_size long, target double, words long, blocks long, shards long",
    )
    rows = (
        sized.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source", "words", "blocks")
        .withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "hash"))
        .withColumn("shard", F.pmod("place", "shards"))
    )
    shard_sizes = rows.groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size")).join(
        plan.select("source_no", "source_size", "words", "blocks"), "source_no"
    )
    quotas = _shard_quotas(shard_sizes, block_words, cap)
    laid = Window.partitionBy("source_no", "shard").orderBy("place", "doc_id", "hash")
    placed = (
        rows.withColumn("end", F.sum("size").over(laid.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("start", F.col("end") - F.col("size"))
        .join(quotas, ["source_no", "shard"])
    )
    # Turn by turn the permuted blocks are taken until the rest of the quota is; the last block is short.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block_words))
    shift = F.pmod(F.xxhash64(F.lit(seed), "source_no", "shard"), F.col("blocks"))
    turn = lambda b: F.pmod(b * PRIME + F.col("shift"), F.col("blocks"))
    short = F.col("blocks") * block_words - F.col("shard_size")
    gone = lambda b: turn(b) * block_words - F.when(turn(b) > F.col("last_turn"), F.col("short")).otherwise(F.lit(0))
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(F.lit(0))

    def parts(b):
        """The block's first words, taken once more than the others, and the others, within the document."""
        left, right = b * block_words, F.least((b + 1) * block_words, F.col("shard_size"))
        cut = F.least(right, left + F.greatest(F.lit(0), F.col("extra") - gone(b)))
        inside = lambda x: F.greatest("start", F.least("end", x)) - F.col("start")
        one = lambda a, z, n: F.struct(
            inside(a).cast("long").alias("start"), inside(z).cast("long").alias("end"), n.cast("long").alias("times")
        )
        return F.array(one(left, cut, F.col("rounds") + 1), one(cut, right, F.col("rounds")))

    all_blocks = F.sequence(
        F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words)
    )
    taken = F.filter(F.flatten(F.transform(all_blocks, parts)), lambda s: (s["times"] > 0) & (s["end"] > s["start"]))
    return (
        placed.withColumn("blocks", blocks).withColumn("shift", shift).withColumn("short", short)
        .withColumn("last_turn", turn(F.col("blocks") - 1)).withColumn("rounds", rounds.cast("long"))
        .withColumn("extra", F.col("quota") - F.col("rounds") * F.col("shard_size"))
        .withColumn("spans", F.coalesce(F.when(F.col("size") > 0, taken), F.array().cast(spans_type)))
        .withColumn(
            "taken",
            F.aggregate(
                "spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]) * s["times"]
            ),
        )
        .select("doc_id", "source", "hash", "size", "source_size", "target", "taken", "spans")
    )


def words_of_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text's words within spans (start, end), with the white space between neighbours as it was.

    Words apart are joined by a line break; a span over all words gives the whole text.
    """
    at = [m.span() for m in re.finditer(WORD, text)]
    joined: list[list[int]] = []
    for start, end in sorted(spans):
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(end, joined[-1][1])
        else:
            joined.append([start, end])
    if joined == [[0, len(at)]]:
        return text
    return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in joined)
