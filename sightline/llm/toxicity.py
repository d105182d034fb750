"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The labelled rows are split by hash: one part finds the words and word beginnings that mark toxic texts,
one fits the trees, one the calibration. Every whole text is then turned into a few rates and scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from sightline.llm.common import parted, pick, staged

# Words to start from; labels add the words of the corpus.
INSULTS = (
    "idiot", "moron", "stupid", "trash", "scum", "loser", "clown", "pathetic", "worthless", "disgusting",
    "dumb", "imbecile", "vermin", "hate", "dumm", "abschaum", "imbécile", "stupide", "ordure", "basura",
    "estúpido", "escoria",
)
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "ya", "u", "du", "dich", "dir", "dein", "deine", "ihr", "euch",
    "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "ti", "tus", "usted", "ustedes",
)
PREFIXES = range(3, 9)
NEAR = 3
FEATURES = (
    "listed", "learned", "learned_words", "learned_weight", "strongest", "distinct_strong", "near_second_person",
    "second_person", "capitals", "capital_words", "punctuation", "exclamations", "digits", "obfuscated",
    "stretched", "log_words",
)
EDGES = re.compile(r"^\W+|\W+$")
OBFUSCATED = re.compile(r"[^\W\d_][@$!*0-9|#]+[^\W\d_]")
STRETCHED = re.compile(r"(.)\1\1")
_UPPER = np.array([chr(i).isascii() and chr(i).isupper() for i in range(256)])
_DIGIT = np.array([48 <= i < 58 for i in range(256)])
_PUNCT = np.array([33 <= i < 127 and not chr(i).isalnum() for i in range(256)])


def terms_of(text: str) -> set[str]:
    """A text's distinct words, and their beginnings marked by a final hyphen."""
    words = {EDGES.sub("", w) for w in set(text.lower().split())}
    words = {w for w in words if 2 <= len(w) <= 40}
    return words | {w[:n] + "-" for w in words for n in PREFIXES if len(w) > n}


class Features:
    """Dense features of a text, given the weights of the learned terms.

    What a word says is worked out once and remembered, for a bounded number of words.
    """

    KNOWN = 200_000

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.codes: dict[str, int] = {}
        self.kinds: dict[tuple, int] = {}
        self.rows: list[tuple] = []
        self.table = np.zeros((0, 6))

    def _code(self, raw: str) -> int:
        word = EDGES.sub("", raw)
        low = word.lower()
        found = [self.weights[low]] if low in self.weights else []
        whole = bool(found)
        found += [self.weights[p] for n in PREFIXES if len(low) > n and (p := low[:n] + "-") in self.weights]
        kind = (
            float(low in INSULTS), max(found, default=0.0), float(whole), float(low in SECOND_PERSON),
            float(len(word) > 1 and word.isupper()),
            float(bool(OBFUSCATED.search(word))) + 2.0 * float(bool(STRETCHED.search(low))),
        )
        code = self.kinds.get(kind)
        if code is None:
            code = self.kinds[kind] = len(self.rows)
            self.rows.append(kind)
        if len(self.codes) >= self.KNOWN:
            self.codes.clear()
        self.codes[raw] = code
        return code

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        words = text.split()
        n = max(len(words), 1)
        known = self.codes.get
        codes = np.array([c if (c := known(w)) is not None else self._code(w) for w in words], dtype=np.int64)
        if len(self.table) != len(self.rows):
            self.table = np.array(self.rows).reshape(-1, 6)
        told = self.table[codes] if len(words) else np.zeros((0, 6))
        listed, weight, whole, second, capital, odd = told.T
        strong = (listed > 0) | (weight >= 2)
        marks = np.convolve(second, np.ones(2 * NEAR + 1), "same")[: len(words)] if len(words) > 2 * NEAR else second * 0 + second.any()
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        counts = np.bincount(raw, minlength=256)
        size = max(len(raw), 1)
        return [
            listed.sum() / n, strong.sum() / n, (strong * whole).sum() / n, weight.sum() / n, float(weight.max(initial=0.0)),
            float(len(np.unique(codes[strong]))) if len(words) else 0.0, float((strong * (marks > 0)).sum()) / n,
            second.sum() / n, counts[_UPPER].sum() / size, capital.sum() / n, counts[_PUNCT].sum() / size,
            counts[33] / size, counts[_DIGIT].sum() / size, float((odd % 2 == 1).sum()) / n, float((odd >= 2).sum()) / n,
            math.log1p(len(words)),
        ]


def with_features(docs: DataFrame, weights: dict[str, float], *names: str) -> DataFrame:
    """The named columns and ``features``, from a table with these and text.

    Python gets nothing but the texts, however wide the rows, and reads a few at once.
    """

    def features(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tell = Features(weights)
        pa.default_memory_pool().release_unused()  # a worker serves several stages
        for column in columns:
            rows = [np.array([tell(x) for x in part.to_pylist()], dtype=np.float64).reshape(-1) for part in parted(column)]
            flat = np.concatenate([np.zeros(0), *rows])
            offsets = pa.array(np.arange(0, len(flat) + 1, len(FEATURES)), pa.int32())
            yield pa.ListArray.from_arrays(offsets, pa.array(flat))

    # Nondeterministic only in name: else a filter on the score would have every text read twice.
    tell = F.arrow_udf(features, ArrayType(DoubleType())).asNondeterministic()
    return docs.select(*names, tell("text").alias("features"))


def learn_terms(labelled: DataFrame, min_docs: int = 4, min_log_odds: float = 1.5, min_z: float = 2.5, max_terms: int = 3_000) -> dict[str, float]:
    """Log odds of the terms that mark toxic texts, from rows with text and toxic.

    Terms of at least ``min_docs`` toxic texts are weighed, however rare. ``max_terms`` bounds what the
    driver holds: the surest.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for part in parted(batch.column("text")):
                for text in part.to_pylist():
                    found.update(terms_of(text or ""))
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["term", "n"]
        )

    def counted(texts: DataFrame, name: str) -> DataFrame:
        return texts.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias(name))

    toxic, clean = labelled.where("toxic = 1").select("text"), labelled.where("toxic = 0").select("text")
    n_toxic, n_clean = toxic.count(), clean.count()
    both = counted(toxic, "n").where(F.col("n") >= min_docs).join(counted(clean, "others"), "term", "left")
    a, b = F.col("n") + 0.5, F.coalesce("others", F.lit(0)) + 0.5
    weight = F.log(a / (n_toxic + 1)) - F.log(b / (n_clean + 1))
    weighed = both.select("term", weight.alias("weight"), (weight / F.sqrt(1 / a + 1 / b)).alias("z"))
    marks = weighed.where((F.col("weight") >= min_log_odds) & (F.col("z") >= min_z))
    return {r["term"]: r["weight"] for r in marks.orderBy(F.desc("z"), "term").limit(max_terms).collect()}


def may_learn(doc_id: Column) -> Column:
    """Whether a row's label may be learned from: crc32 of its id as text is not divisible by 5."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) != 0


def score_toxicity(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, trees: int = 20, depth: int = 4, seed: int = 5,
    carry: bool = False,
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) of every whole text.

    Learns from at most about ``max_labelled`` labelled documents (those of smallest hash) whose
    crc32(doc_id) is not divisible by 5; a document labelled more than once counts as toxic if one label
    says so. Only text is an input of the score. A null text is scored as an empty one. Repeated rows
    score alike. Rows without doc_id are scored and not held out. Without both labels to learn from, the
    score is 1 - exp(-50 x density of listed insults). An empty table gives an empty result. With ``carry``
    the column ``row`` holds each whole input row, as a struct.
    """
    known = (
        pick(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & may_learn(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    n = known.count()
    scale = 1 << 40
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(scale))
    chosen = known.where(place < min(scale, int(scale * max_labelled / max(n, 1))))
    texts = pick(docs, "doc_id", "text")
    if carry:
        apart = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        texts = apart.select(
            *[F.col(f"c{docs.columns.index(n)}").alias(n) for n in ("doc_id", "text")], F.struct(*apart.columns).alias("row")
        )
    # Bounded by max_labelled.
    sample = staged(texts.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), "labelled")
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(20))
    words, fitted = sample.where(fold < 9), sample.where(fold >= 9)
    weights = learn_terms(words)
    prepared = staged(with_features(fitted, weights, "doc_id", "toxic"), "features").select(
        "toxic", array_to_vector("features").alias("features"), fold.alias("fold")
    )
    tree_rows, iso_rows = prepared.where("fold < 17"), prepared.where("fold >= 17")
    held = ~may_learn(F.col("doc_id")) & F.col("doc_id").isNotNull()
    scored = with_features(texts, weights, "doc_id", *(["row"] if carry else []))
    if tree_rows.select("toxic").distinct().count() < 2:
        score = 1 - F.exp(F.lit(-50.0) * F.element_at("features", 1))
        rows = scored.withColumn("score", score)
    else:
        model = GBTClassifier(
            featuresCol="features", labelCol="toxic", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, minInstancesPerNode=3
        ).fit(tree_rows)
        chance = vector_to_array("probability")[1]
        judged = model.transform(scored.withColumn("features", array_to_vector("features"))).withColumn("chance", chance)
        both = model.transform(iso_rows).withColumn("chance", chance).select("chance", F.col("toxic").cast("double").alias("toxic"))
        if both.select("toxic").distinct().count() == 2:
            curve = IsotonicRegression(featuresCol="chance", labelCol="toxic", predictionCol="calibrated").fit(both)
            # A thousandth of the raw chance keeps the order within the curve's flat steps.
            rows = curve.transform(judged).withColumn("score", 0.999 * F.col("calibrated") + 0.001 * F.col("chance"))
        else:
            rows = judged.withColumn("score", F.col("chance"))
    return rows.select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), *(["row"] if carry else []),
    )
