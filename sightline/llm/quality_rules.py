"""Quality rules as a short-circuit cascade.

On a bounded sample every rule is run on every text, timed, and its verdict kept. From these the rules are
ordered: always the one next that rejects most of what is left for its cost. The whole table then meets
the rules in that order, and a text that one rejects is not shown to the later ones. Rules only reject, so
the order decides the time taken and never which texts are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import mixed, pick

#: A word's letters from its first one on: one match a word that has a letter.
_LETTER_WORD = regex.compile(r"\p{L}[^\x20\x09-\x0D]*")
_SYMBOLS = "#*$%&|<>"
WINDOW = 8
_M1 = np.uint64(0x9E3779B97F4A7C15)


class Text:
    """The measures of one text, each computed when first asked for. Null texts are empty."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - len(self.data) + sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.data.split(b"\n") if line.strip()]

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_letter_words(self) -> int:
        return sum(1 for _ in _LETTER_WORD.finditer(self.text))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of eight words that occur twice or more."""
        n = len(self.words) - WINDOW + 1
        if n < 2:
            return 0
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in self.words), np.uint64, len(self.words))
        hashes = np.zeros(n, dtype=np.uint64)
        for i in range(WINDOW):
            hashes = mixed(hashes * _M1 + ids[i : i + n])
        if len(np.unique(hashes)) == n:
            return 0  # equal windows have equal hashes
        # Exact: number the runs of 2, 4 and 8 words by the numbers of their halves.
        runs, size = ids.astype(np.int64), 1
        while size < WINDOW:
            pairs = runs[: len(runs) - size] * (int(runs.max()) + 1) + runs[size:]
            runs, size = np.unique(pairs, return_inverse=True)[1].astype(np.int64), 2 * size
        twice = np.flatnonzero(np.bincount(runs)[runs] > 1)
        edges = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.add.at(edges, twice, 1)
        np.add.at(edges, twice + WINDOW, -1)
        return int(np.count_nonzero(np.cumsum(edges)))


@dataclass(frozen=True)
class Rule:
    """``rejects`` says whether a text goes."""

    name: str
    rejects: Callable[[Text], bool]


BASE = (
    Rule("few_words", lambda t: t.n_words < 20),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
)
#: Beyond the base: bounds in common use for web text, on the generous side.
ADDED = (
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("letter_words", lambda t: 10 * t.n_letter_words < 7 * t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > t.n_lines),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Estimate:
    """What the sample says: mean seconds a text per rule, and texts per set of rejecting rules (bits)."""

    seconds: tuple[float, ...]
    outcomes: dict[int, int]


def estimate(docs: DataFrame, rules: tuple[Rule, ...], measures: tuple[str, ...], sample_rows: int, seed: int) -> Estimate:
    """Time every rule on about ``sample_rows`` texts, after the measures that are reported anyway."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outcomes, seconds = [], []
            for text in batch.column("text").to_pylist():
                t = Text(text)
                for name in measures:
                    getattr(t, name)
                bits, took = 0, []
                for i, rule in enumerate(rules):
                    start = time.perf_counter()
                    bits |= rule.rejects(t) << i
                    took.append(time.perf_counter() - start)
                outcomes.append(bits)
                seconds.append(took)
            yield pa.RecordBatch.from_arrays(
                [pa.array(outcomes, pa.int64()), pa.array(seconds, pa.list_(pa.float64()))], names=["outcome", "seconds"]
            )

    texts = pick(docs, "text")
    share = min(1.0, sample_rows / max(1, docs.count()))
    seen = texts.sample(fraction=share, seed=seed).mapInArrow(probe, "outcome long, seconds array<double>")
    sums = [F.sum(F.col("seconds")[i]).alias(f"s{i}") for i in range(len(rules))]
    rows = seen.groupBy("outcome").agg(F.count("*").alias("n"), *sums).collect()  # as many as the sample has
    n = max(1, sum(r["n"] for r in rows))
    return Estimate(tuple(sum(r[f"s{i}"] for r in rows) / n for i in range(len(rules))), {r["outcome"]: r["n"] for r in rows})


def cascade_order(found: Estimate) -> list[int]:
    """Rules by rejections per cost, each judged on the sampled texts that the ones before it leave."""
    left, order, open_ = dict(found.outcomes), [], list(range(len(found.seconds)))
    while open_:
        total = max(1, sum(left.values()))
        gain = lambda i: sum(n for bits, n in left.items() if bits >> i & 1) / total / max(found.seconds[i], 1e-9)
        best = max(open_, key=lambda i: (gain(i), -found.seconds[i], -i))
        order.append(best)
        open_.remove(best)
        left = {bits: n for bits, n in left.items() if not bits >> best & 1}
    return order


def quality_cascade(
    docs: DataFrame,
    rules: tuple[Rule, ...] = BASE + ADDED,
    base: int = len(BASE),
    measures: tuple[str, ...] = MEASURES,
    sample_rows: int = 2_000,
    seed: int = 11,
) -> DataFrame:
    """Judge every whole text by rules, the cheapest rejections first.

    The first ``base`` rules are the base. Returns per row doc_id, the named ``measures`` (long), which are
    taken of every text, base_failed, kept, ``rejected_by`` (the first rule in cascade order that rejects,
    null if kept) and ``rules_run`` (rules shown the text). base_failed is computed for every row; only
    rejected_by and rules_run depend on the measured order. A null text is an empty one and fails. Repeated
    rows and rows without doc_id are judged like others; an empty table gives an empty result. Columns
    besides doc_id and text are ignored. The sample of about ``sample_rows`` texts decides the order alone.
    """
    order = cascade_order(estimate(docs, rules, measures, sample_rows, seed))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(len(measures) + 4)]
            for text in batch.column("text").to_pylist():
                t = Text(text)
                row = [getattr(t, name) for name in measures]
                rejected, run = None, 0
                for i in order:
                    run += 1
                    if rules[i].rejects(t):
                        rejected = i
                        break
                failed = rejected is not None and rejected < base
                if rejected is not None and not failed:
                    failed = any(rule.rejects(t) for rule in rules[:base])
                for column, value in zip(out, [*row, failed, rejected is None, None if rejected is None else rules[rejected].name, run]):
                    column.append(value)
            kinds = [*[pa.int64()] * len(measures), pa.bool_(), pa.bool_(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x, kind) for x, kind in zip(out, kinds)]],
                names=["doc_id", *measures, "base_failed", "kept", "rejected_by", "rules_run"],
            )

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fields = "".join(f", {name} long" for name in measures)
    return rows.mapInArrow(judge, f"doc_id long{fields}, base_failed boolean, kept boolean, rejected_by string, rules_run int")
