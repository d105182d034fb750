import math
import re
import zlib

from pyspark.sql import functions as F

from sightline.llm.queries import op2_toxicity
from sightline.llm.toxicity import FEATURES, Features, learn_terms, score_toxicity, terms_of
from tests.llm.conftest import DOC, no_documents, odd_documents, rows_of


def area(rows):
    """Share of (toxic, clean) pairs in the right order."""
    toxic, clean = [s for s, t in rows if t], [s for s, t in rows if not t]
    return sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op2_toxicity(spark, folder).collect()
    assert len(rows) == 10_000
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    right = sum(t == p for _, t, p in held) / len(held)
    print("held out", len(held), "area", area([(s, t) for s, t, _ in held]), "accuracy", right)
    assert area([(s, t) for s, t, _ in held]) > 0.8 and right > 0.93


def test_odd_rows(spark):
    labels = spark.createDataFrame(
        [(i, 1, i % 2, "x") for i in range(60)] + [(None, 1, 1, "x"), (3, 0, None, "x"), (4, 0, 0, "x"), (4, 0, 1, "x")],
        "doc_id long, quality int, toxic int, Score string",
    )
    docs = spark.createDataFrame([(i, f"you are trash {i}" if i % 2 else f"a fine day {i}", "en", "s", 1) for i in range(60)], DOC)
    odd = odd_documents(spark)
    for known in (labels, labels.limit(0)):
        rows = score_toxicity(odd, known).collect()
        assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 5}) == 1
        assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    both = {r["doc_id"]: r["predicted"] for r in score_toxicity(docs, labels).collect()}
    assert sum(both[i] == i % 2 for i in range(60)) >= 58
    assert score_toxicity(no_documents(spark), labels).collect() == []


def test_features():
    tell = Features({"zork": 3.0, "zor-": 2.5})
    got = dict(zip(FEATURES, tell("You ZORK! are an id1ot zorkel, ok")))
    assert got["learned"] == 2 / 7 and got["learned_words"] == 1 / 7 and got["near_second_person"] == 1 / 7
    assert got["capital_words"] == 1 / 7 and got["obfuscated"] == 1 / 7 and got["strongest"] == 3.0
    assert len(tell(None)) == len(FEATURES) and tell("") == tell(None)
    assert terms_of("Abcd, x") == {"abcd", "abc-"}


def test_carried_rows_stay_out_of_python(spark):
    docs = spark.createDataFrame([(i, f"you are trash {i}" if i % 2 else f"a fine day {i}", "en", "s", i) for i in range(60)], DOC)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    scored = score_toxicity(docs, labels, carry=True)
    assert sorted(tuple(r["row"]) for r in scored.collect()) == sorted(tuple(r) for r in docs.collect())
    kept = scored.where("predicted = 0").select("row.*")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    # Python is asked once, and for one column.
    asked = re.findall(r"ArrowEvalPython \[features\((.*?)\)#", plan)
    assert "InArrow" not in plan and len(asked) == 1 and "," not in asked[0]
    assert kept.count() in range(28, 33)


def test_rare_terms_are_weighed_among_many_frequent_ones(spark):
    many = " ".join(f"{i:05d}abc" for i in range(15_000))
    rows = [(1, i < 6, i < 5) for i in range(20)] + [(0, i < 30, False) for i in range(200)]
    df = spark.createDataFrame(rows, "toxic int, common boolean, rare boolean").repartition(4)
    text = F.concat(F.when(F.col("common"), F.lit(many)).otherwise(F.lit("")), F.when(F.col("rare"), F.lit(" zork")).otherwise(F.lit("")))
    got = learn_terms(df.select("toxic", text.alias("text")))
    weight = math.log(5.5 / 21) - math.log(0.5 / 201)
    assert set(got) == {"zork", "zor-"} and all(abs(x - weight) < 1e-12 for x in got.values())
