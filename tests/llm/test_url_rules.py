import math
import random
import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from sightline.llm.queries import op4_url_rules
from sightline.llm.url_rules import RULES, judge_urls, mine_rules, with_mined
from tests.llm.conftest import rows_of


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def checked(rows, urls):
    assert sorted((r["page_id"] for r in rows), key=str) == sorted((i for i, _ in urls), key=str)
    by_id = dict(urls)
    for r in rows:
        host, path = split(by_id[r["page_id"]])
        name, verdict = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, name)
        assert r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])


def test_all_pages(spark, small):
    checked(op4_url_rules(spark, small).collect(), [(r["page_id"], r["url"]) for r in rows_of("pages")])


def test_mined_rules_judge_the_rest(spark):
    urls = [(i, f"http://h{i}.x.com/de/{i}") for i in range(40)] + [(100 + i, f"http://h{i}.x.com/fr/{i}") for i in range(40)]
    urls += [(500, "http://new.net/de/77"), (501, "http://new.net/fr/77"), (502, "http://new.net/it/77")]
    rows = judge_urls(spark.createDataFrame(urls, "page_id long, url string")).collect()
    checked(rows, urls)
    assert {r["page_id"]: r["verdict"] for r in rows if r["page_id"] >= 500} == {500: "block", 501: "allow", 502: "allow"}


def test_odd_urls(spark):
    urls = [
        (1, None), (2, ""), (3, "no scheme/path"), (4, "://ORG/x"), (5, "http://org?x=/"), (6, "http://a.ORG/#/es/"), (7, "http://Example.org/es/1"),
        (8, "http://sub.example.org/en/1x?y"), (9, "http://notexample.org/en/1"), (10, "http://xorg/"), (11, "ftp://a://b/c"), (12, "http://a.com/fr"),
        (13, "http://a\nb.com/de/\nx"), (14, "http://" + "a." * 5000 + "com/de/" + "x" * 10000), (15, "http://É.com/fr/"), (16, "x://"), (None, "http://q.com/de/"),
    ]
    df = spark.createDataFrame([(*u, "z", 1) for u in urls], "page_id long, url string, host string, Verdict int")
    checked(judge_urls(df).collect(), urls)
    repeated = judge_urls(df.union(df)).collect()
    assert len(repeated) == 2 * len(urls)
    assert judge_urls(df.limit(0)).collect() == []


def mined_by_hand(labelled, min_support, min_confidence):
    """{(tokens, verdict): (confidence, support)} over all token sets, then without those that a part is as sure as."""
    sets, both = Counter(), Counter()
    for tokens, verdict in labelled:
        for k in range(1, len(tokens) + 1):
            for part in combinations(sorted(tokens), k):
                sets[part] += 1
                both[part, verdict] += 1
    least = math.ceil(min_support * len(labelled))
    rules = {k: (n / sets[k[0]], n / len(labelled)) for k, n in both.items() if n >= least and n / sets[k[0]] >= min_confidence}
    return {
        (t, v): c for (t, v), c in rules.items()
        if not any(w == v and set(s) < set(t) and d[0] >= c[0] for (s, w), d in rules.items())
    }


def test_rules_are_pruned_as_parts(spark):
    rng = random.Random(3)
    labelled = []
    for _ in range(300):
        tokens = [f"p:{x}" for x in rng.sample("abcdefgh", rng.randrange(1, 7))]
        labelled.append((tokens, "block" if ("p:a" in tokens) + ("p:b" in tokens) + rng.random() > 1.3 else "allow"))
    got = mine_rules(spark.createDataFrame(labelled, "tokens array<string>, verdict string"), 0.02, 0.6).collect()
    want = mined_by_hand(labelled, 0.02, 0.6)
    assert {(tuple(r["tokens"]), r["verdict"]): (r["confidence"], r["support"]) for r in got} == want
    assert len(got) == len(want) and max(len(t) for t, _ in want) >= 3


def test_supersets_of_sure_rules_push_out_no_other(spark):
    deep = "/".join(["de", "cat", "garden", "tools", "hand", "spade", "steel", "long", "sale"])
    urls = [(i, f"http://shop.example.com/{deep}/{i}") for i in range(60)]
    # Four of five urls with "news" are blocked; the block of deep urls alone makes thousands of surer rules.
    urls += [(100 + i, f"http://a{i}.com/{'de' if i % 5 else 'fr'}/news/{i}") for i in range(40)]
    urls += [(500, "http://new.net/news/x")]
    rows = judge_urls(spark.createDataFrame(urls, "page_id long, url string")).collect()
    checked(rows, urls)
    assert {r["page_id"]: r["verdict"] for r in rows}[500] == "block"


def test_many_rules_are_joined(spark):
    rng = random.Random(4)
    rules = list({(tuple(sorted(rng.sample("abcdefgh", rng.randrange(1, 4)))), rng.choice(("allow", "block"))): 0 for _ in range(60)})
    rules = [(list(t), v, rng.choice((0.7, 0.8, 0.9)), rng.choice((0.1, 0.2))) for t, v in rules]
    urls = [(i, None, rng.sample("abcdefghxyz", rng.randrange(0, 6))) for i in range(200)] + [(7, "allow", ["a"]), (None, None, ["a", "b"]), (3, None, ["a", "b"])]
    judged = spark.createDataFrame(urls, "page_id long, l string, tokens array<string>").withColumn("listed", F.when(F.col("l").isNotNull(), F.struct(F.col("l").alias("verdict"))))
    table = spark.createDataFrame(rules, "tokens array<string>, verdict string, confidence double, support double")
    seen = []
    for most in (1000, 5):
        got = with_mined(judged, table, most).where("listed is null").select("page_id", "tokens", "mined").collect()
        seen.append(sorted(((r["page_id"], tuple(r["tokens"]), r["mined"]) for r in got), key=str))
    want = []
    for i, listed, tokens in urls:
        if listed is None:
            fits = [(-c, -s, len(t), t, v) for t, v, c, s in rules if set(t) <= set(tokens)]
            want.append((i, tuple(tokens), min(fits)[4] if fits else None))
    assert seen[0] == seen[1] == sorted(want, key=str)
