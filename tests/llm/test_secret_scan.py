import hashlib
import random
import re

from sightline.llm import secret_scan
from sightline.llm.queries import op10_secrets
from sightline.llm.secret_scan import ADDED, BASE, any_trigram, find_secrets, trigram_query
from tests.llm.conftest import no_documents, odd_documents


def brute(text):
    spans = []
    for number, rule in enumerate([*BASE, *ADDED]):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                spans.append((m.start(), number, m.end(), rule.kind))
    return sorted(spans)


def said(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def test_queries_of_the_rules():
    by_kind = {r.kind: trigram_query(r.pattern) for r in [*BASE, *ADDED]}
    assert by_kind["hex"] == []
    assert by_kind["access"] == [[frozenset({"aki", "kia"})]]
    words = {frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")}
    assert {c for run in by_kind["assign"][:1] for c in run} == words
    assert len(by_kind["github"][0]) == 5 and len(by_kind["private_key"]) == 2
    assert trigram_query("(ab)+c") == [] and trigram_query("abc|de") == []
    assert [set(run) for run in trigram_query("x(abc|abd)?yzw")] == [{frozenset({"yzw", "xyz"}), frozenset({"abc", "xab", "bcy", "cyz", "yzw"}), frozenset({"abd", "xab", "bdy", "dyz", "yzw"})}]


def test_all_documents(spark):
    folder = "/root/testdata/sf0.01"  # the smallest one holds no secrets
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op10_secrets(spark, folder).collect()
    assert len(rows) == len(docs)
    hits = 0
    for r in rows:
        spans = brute(docs[r["doc_id"]])
        base = [s for s in spans if s[1] < len(BASE)]
        hits += len(base)
        assert r["spans"] == said(spans)
        assert r["base_sha256"] == hashlib.sha256(said(base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[3] == k for s in spans) for k in ("assign", "access", "hex"))
    assert hits


def test_made_up_texts(spark):
    rng = random.Random(5)
    parts = [
        "password", "PassWd = ", "secret", "token: '", 'api_key="', "APIKEY", ":", "=", " ", "é", "😀", "\n", "abcdef", "a1b2c3d4e5f6" * 2,
        "AKIA", "ABCDEFGH12345678", "deadbeef" * 4, "ghp_" + "x1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "ſecret=abcdefgh", "toKen=abcdefgh",
        "xoxb-1234567890ab", "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 8, "secret = token=abc123", "password=abc",
    ]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["rule"], s["end"], s["kind"]) for s in r["found"]] for r in find_secrets(df).collect()}
    assert got == {i: brute(t) for i, t in docs}


def test_odd_rows(spark):
    extra = [(None, "token=abcdefgh", "en", "s", 1, "T", 1.0, "z")] * 2 + [(5, "secret: " + "f" * 30, "en", "s", 1, "T", 1.0, "z")]
    df = odd_documents(spark)
    rows = find_secrets(df.union(spark.createDataFrame(extra, df.schema))).collect()
    found = sorted(said(map(tuple, r["found"])) for r in rows)
    assert found == [""] * 11 + ["assign:0:14", "assign:0:14", "assign:0:38,hex:8:38"]
    assert find_secrets(no_documents(spark)).collect() == []


def test_trigrams_that_overlap_are_all_found(spark):
    words = ["aaa", "aab", "aba", "---", "_ke", "k[y", "é.x"]
    text = "aaab--aaaba---- api_key k[y é.x éyx 😀aab"
    want = {w for w in words if w in text}
    (got,) = spark.createDataFrame([(text,)], "text string").selectExpr(f"regexp_extract_all(text, r'{any_trigram(words)}', 1) as t").first()
    assert set(got) == want and got.count("aab") == 3 and got.count("---") == 2


def test_bit_table_loses_no_candidate(spark, monkeypatch):
    docs = [(i, f"token=abcdef{i}" if i % 3 else f"tok en {i}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for words in (1, 4, secret_scan.FILTER_WORDS):
        monkeypatch.setattr(secret_scan, "FILTER_WORDS", words)
        got = {r["doc_id"]: [(s["start"], s["rule"], s["end"], s["kind"]) for s in r["found"]] for r in find_secrets(df).collect()}
        assert got == {i: brute(t) for i, t in docs}
