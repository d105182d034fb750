import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sightline.llm.packing import _Encoder, best_fit_packing, best_fit_plan
from sightline.llm.queries import op8_packing
from tests.llm.conftest import LONG, no_documents, odd_documents, rows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER, PLAIN = _Encoder(PATH), Tokenizer.from_file(PATH)


def best_fit(lengths, capacity):
    """Piece by piece, for comparison."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fitting = [i for i, r in enumerate(rooms) if r >= x]
        if fitting:
            i = min(fitting, key=lambda i: rooms[i])
            rooms[i] -= x
        else:
            rooms.append(capacity - x)
    return rooms


@settings(deadline=None, max_examples=150)
@given(st.dictionaries(st.integers(1, 20), st.integers(0, 9), max_size=12))
def test_plan_is_best_fit(histogram):
    plan = best_fit_plan(histogram, 20)
    filled = {}
    for length, n in histogram.items():
        if not n:
            continue
        runs = plan[length]
        assert [r[0] for r in runs] == sorted({r[0] for r in runs}) and runs[0][0] == 0
        for (rank, first, offset), after in zip(runs, [*(r[0] for r in runs[1:]), n]):
            for i in range(after - rank):
                filled.setdefault(first + i, []).append((offset, length))
    rooms = []
    for parts in filled.values():
        parts.sort()
        end = 0
        for offset, length in parts:
            assert offset == end
            end += length
        assert end <= 20
        rooms.append(20 - end)
    assert sorted(rooms) == sorted(best_fit([x for x, n in histogram.items() for _ in range(n)], 20))


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(alphabet="ab c\n\t'd1.é\x1c <|", max_size=30), max_size=4))
def test_encoding_is_exact(texts):
    texts = [*texts, "it's a <|endoftext|> test  of two", " lead", "trail ", "a b\n c", "x" * 3000, "\n \t" * 900]
    want = [np.array(PLAIN.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert list(ENCODER.batch(texts)) == want


def checked(rows, docs, whole=True):
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in docs.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["start"] for r in pieces] == list(np.cumsum([0, *(r["length"] for r in pieces)])[:-1])
        assert all(r["length"] == 1024 for r in pieces[1:])
        for r in pieces:
            part = np.array(ids[i][r["start"] : r["start"] + r["length"]], dtype="<u4")
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert sum(r["length"] for r in pieces) == len(ids[i])
    for parts in by_sequence.values() if whole else ():
        parts.sort()
        assert [p[0] for p in parts] == list(np.cumsum([0, *(p[1] for p in parts)])[:-1])
        assert sum(p[1] for p in parts) <= 1024
    return by_sequence


def test_all_documents(spark, small):
    docs = {r["doc_id"]: r["text"] for r in rows_of("documents")}
    rows = op8_packing(spark, small).collect()
    sequences = checked(rows, docs)
    assert len(sequences) == len(best_fit([r["length"] for r in rows], 1024))


def test_odd_rows(spark):
    rows = best_fit_packing(odd_documents(spark), PATH).collect()
    assert sum(r["doc_id"] == 5 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 2
    one = [r for r in rows if r["doc_id"] not in (5, None)]
    checked_ids = {1: "a b c d e f g h i j", 2: "", 3: None, 4: LONG, 6: " \n\t ", 7: "naïve ünïcode 😀 text\nwith lines", 8: "a b c d e f g h i j"}
    assert {r["doc_id"] for r in one} == set(checked_ids)
    tokenizer = Tokenizer.from_file(PATH)
    for i, t in checked_ids.items():
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        assert sum(r["length"] for r in one if r["doc_id"] == i) == n
    places = {(r["sequence_id"], r["offset"]) for r in rows}
    assert len(places) == len(rows)
    assert best_fit_packing(no_documents(spark), PATH).collect() == []


@pytest.mark.parametrize("capacity", [1, 7])
def test_small_capacity(spark, capacity):
    rows = best_fit_packing(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), PATH, capacity).collect()
    assert sum(r["length"] for r in rows) == 7 and max(r["length"] for r in rows) <= capacity


def test_many_rows_without_id(spark):
    """Rows that share everything but their number are spread over tasks and each get a slot."""
    df = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words").alias("text"))
    rows = best_fit_packing(df, PATH)
    places = rows.groupBy("sequence_id", "offset").count()
    assert rows.count() == 50_000 and places.count() == 50_000
    length = rows.first()["length"]
    assert rows.agg(F.max("offset")).first()[0] == (1024 // length - 1) * length
    assert rows.select("sequence_id").distinct().count() == -(-50_000 // (1024 // length))
