import re

import corpus_pipeline
from sightline.llm.queries import op2_toxicity
from tests.llm.conftest import DOC, odd_documents, rows_of
from tests.llm.test_jaccard_join import brute as groups
from tests.llm.test_line_dedup import brute as repeated
from tests.llm.test_packing import checked

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_one_by_one(spark, small):
    """Each stage against its own input."""
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_jaccard", "mix_sources", "best_fit_packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    source = {r["doc_id"]: r for r in rows_of("documents")}

    clean = spark.createDataFrame(stages["toxicity"](spark, docs, small).collect(), DOC)
    kept = {r["doc_id"]: r for r in clean.collect()}
    toxic = {r["doc_id"] for r in op2_toxicity(spark, small).collect() if r["predicted"]}
    assert clean.columns == docs.columns and len(toxic) <= 0.2 * len(source)
    assert all(kept[i].asDict() == source[i] for i in kept)
    assert set(kept) == set(source) - toxic

    lines = spark.createDataFrame(stages["line_dedup"](spark, clean, small).collect(), DOC)
    want = {}
    for i, removed in repeated([(i, r["text"]) for i, r in kept.items()], 2, 40).items():
        text = "\n".join(x for n, x in enumerate(kept[i]["text"].split("\n")) if n not in removed)
        if not removed or text.strip():
            want[i] = text
    got = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert got == want and all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    single = spark.createDataFrame(stages["ngram_jaccard"](spark, lines, small).collect(), DOC)
    first = {i for i, (_, c) in groups(list(got.items()), 5, 8, 10).items() if c == i}
    assert {r["doc_id"]: r["text"] for r in single.collect()} == {i: got[i] for i in first}

    mixed = spark.createDataFrame(stages["mix_sources"](spark, single, small).collect(), DOC)
    times = {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        words = WORD.findall(got[r["doc_id"]])
        it = iter(words)
        assert all(w in it for w in WORD.findall(r["text"])) and r["n_chars"] == len(r["text"])
    assert max(times.values()) <= 2
    total = sum(len(WORD.findall(got[i])) for i in first)
    taken = sum(len(WORD.findall(r["text"])) for r in mixed.collect())
    assert abs(taken - 1.5 * total) < 0.1 * total

    packed = stages["best_fit_packing"](spark, mixed, small).collect()
    assert {r["doc_id"] for r in packed} == set(times)
    one = {r["doc_id"]: r["text"] for r in mixed.collect() if times[r["doc_id"]] == 1}
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    checked([r for r in packed if r["doc_id"] in one], one, whole=False)


def test_odd_rows_run_through(spark, small, tmp_path):
    for rows, name in ((odd_documents(spark), "odd"), (odd_documents(spark).limit(0), "none")):
        folder = f"{tmp_path}/{name}"
        plain = rows.toDF("doc_id", "text", "lang", "source", "n_chars", "extra", "size", "row")
        plain.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert (len(got) > 0) == (name == "odd")


def test_copies_are_judged_by_their_own_text(spark, small):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a), (2, a + " z"), (2, b), (3, b + " z"), (4, c), (4, c), (None, c), (None, c + " z"), (None, d), (None, d), (5, None), (5, None), (6, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)
    got = corpus_pipeline.drop_near_copies(spark, docs, small).collect()
    want = [(1, a), (2, b), (4, c), (None, d), (5, None), (5, None), (6, " ")]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
