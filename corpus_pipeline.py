"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import parted, staged, table
from sightline.llm.jaccard_join import linked_rows
from sightline.llm.line_dedup import with_removed, without_lines
from sightline.llm.mixing import mix_sources, words_of_spans
from sightline.llm.packing import best_fit_packing
from sightline.llm.toxicity import score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores below 0.5; rows without text or doc_id are scored like others."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), carry=True)
    return scored.where("predicted = 0").select("row.*").toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of 40 characters or more that repeat an earlier line within two edits.

    Documents of which nothing but white space is left go; n_chars follows the text. Documents that lose
    no line stay as they are, null and empty texts included.
    """
    text = without_lines(F.col("text"), F.col("removed"))
    cut = F.size("removed") > 0
    kept = with_removed(docs).withColumn("text", text).where(~cut | F.col("text").rlike(r"\S"))
    return kept.withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of every group linked by a similarity of 0.8 or more.

    Shingles have five words. Rows are judged each by its own text, also those that share a doc_id or have
    none (these come last); of equal rows one stays. Documents without words stay.
    """
    linked = staged(linked_rows(docs, words=5, similarity=(8, 10), unnamed=True).where(F.col("component").isNotNull()), "linked")
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # Few rows of a component have its smallest doc_id, mostly one; the first of their texts stays.
    heads = linked.where(least).groupBy("component", "doc_id", "hash").agg(F.count("*").alias("n"))
    first = heads.groupBy("component").agg(F.min("hash").alias("first"))
    judged = staged(heads.join(first, "component").withColumn("stays", F.col("hash") == F.col("first")), "heads")
    named = [F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")]
    gone = staged(linked.where(~least).select(*named).union(judged.where("not stays").select(*named)).distinct(), "copies")
    repeated = staged(judged.where("stays and n > 1").select(*named), "repeated")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    kept = docs.withColumn("_text_hash", F.xxhash64("text")).join(gone, same, "left_anti")
    if not repeated.isEmpty():
        again = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_text_hash"])
        kept = kept.join(repeated, same, "left_anti").union(again)
    return kept.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row per document for the first time, one more for a second time.

    Blocks have 512 words. A text taken whole stays as it is; documents of which nothing is taken go.
    """
    taken = mix_sources(docs, block_words=512).where("taken > 0").select(
        F.col("doc_id").alias("m_id"), F.col("hash").alias("m_hash"), "spans", F.explode(F.array(F.lit(1), F.lit(2))).alias("time")
    )
    taken = taken.withColumn("spans", F.filter("spans", lambda s: s["times"] >= F.col("time"))).where(F.size("spans") > 0)
    # A row of the mix for each row; rows that repeat doc_id and text share the columns of one.
    whole = docs.withColumn("m_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "m_hash"])
    same = F.col("doc_id").eqNullSafe(F.col("m_id")) & (whole["m_hash"] == taken["m_hash"])
    names = docs.columns
    rows = whole.join(taken, same).select(*names, F.col("spans").alias("_spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # a worker serves several stages
        for batch in (part for whole in batches for part in parted(whole)):
            texts = [
                words_of_spans(text, [(s["start"], s["end"]) for s in spans])
                for text, spans in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist())
            ]
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names=names)

    return rows.mapInArrow(cut, docs.schema)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept texts in sequences of at most 1024 tokens."""
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: SQL expresses neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
