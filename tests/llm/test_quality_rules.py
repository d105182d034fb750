import random
import re
from collections import Counter

from sightline.llm.common import pick
from sightline.llm.queries import op13_quality_rules
from sightline.llm.quality_rules import ADDED, BASE, Estimate, Rule, Text, cascade_order, estimate, quality_cascade
from tests.llm.conftest import no_documents, odd_documents, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(8)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    n, chars, symbols = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))
    letters = sum(any(c.isalpha() for c in w) for w in words)
    failed = n < 20 or 100 * len(repeated) > 30 * n
    kept = not failed and 10 * symbols <= 3 * n and 2 * n <= chars <= 15 * n and 10 * letters >= 7 * n and 2 * dup <= len(lines)
    return n, chars, symbols, dup, len(repeated), failed, kept


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_all_documents(spark, small):
    texts = {r["doc_id"]: r["text"] for r in rows_of("documents")}
    rows = op13_quality_rules(spark, small).collect()
    assert len(rows) == len(texts)
    assert {r["doc_id"]: tuple(r[n] for n in NAMES) for r in rows} == {i: brute(t) for i, t in texts.items()}
    assert 0 < sum(r["kept"] for r in rows) < len(rows)


def test_made_up_texts(spark):
    rng = random.Random(3)
    parts = ["a", "über", "x1", "42", "|", "#tag", "\n", "\n\n", " ", "😀", "word", "the", "\x0b", "\x1c", "long" * 20, "one two three four five six seven eight"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["same line here\n" * 12, "all of the words in here differ from each other but for symbols |||| ####### and more of the text that follows on"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in quality_cascade(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_order_changes_no_verdict(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    verdict = lambda rules: sorted((r["doc_id"], r["kept"]) for r in quality_cascade(docs, rules, base=0, measures=()).collect())
    assert verdict(BASE + ADDED) == verdict(ADDED[::-1] + BASE[::-1])


def test_cascade_order_by_rejection_per_cost():
    # Rule 0 is dear and rejects 60, rule 1 is cheap and rejects 30 of the same, rule 2 rejects nothing.
    found = Estimate((10.0, 1.0, 0.1), {0b011: 30, 0b001: 30, 0b000: 40})
    assert cascade_order(found) == [1, 0, 2]
    # Once rule 0 is through, rule 1 has nothing left to reject; the cheaper one of two useless rules goes first.
    found = Estimate((1.0, 2.0, 0.5), {0b011: 50, 0b001: 10, 0b000: 40})
    assert cascade_order(found) == [0, 2, 1]
    assert cascade_order(Estimate((), {})) == []


def test_later_rules_are_skipped(spark):
    df = spark.createDataFrame([(1, "w " * 30), (2, "a b")], "doc_id long, text string")
    def slow(t: Text) -> bool:
        return sum(i for i in range(20_000)) < 0

    rules = (Rule("slow", slow), Rule("short", lambda t: t.n_words < 20))
    found = estimate(df, rules, (), 100, 1)
    assert found.seconds[0] > found.seconds[1] and found.outcomes == {0: 1, 0b10: 1}
    rows = {r["doc_id"]: r for r in quality_cascade(df, rules, base=1, measures=("n_words",)).collect()}
    assert (rows[2]["rejected_by"], rows[2]["rules_run"], rows[2]["base_failed"]) == ("short", 1, False)
    assert (rows[1]["rejected_by"], rows[1]["rules_run"], rows[1]["kept"]) == (None, 2, True)


def test_odd_rows(spark):
    df = odd_documents(spark)
    texts = [(r["doc_id"], r["text"]) for r in pick(df, "doc_id", "text").collect()]
    got = [(r["doc_id"], *[r[n] for n in NAMES]) for r in quality_cascade(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted([(i, *brute(t)) for i, t in texts], key=key)
    assert quality_cascade(no_documents(spark)).collect() == []
