"""URL filters: a rule list by host and path, and association rules mined from what it decides.

The listed rules label the urls that they fit. FP-growth mines token combinations from these labelled
urls; rules that conclude a verdict, pruned by support, confidence and their parts, are kept in an inverted
index from token to rules and judge the urls that no listed rule fits.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import pick, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
VERDICTS = ("allow", "block")
#: Tells what the url is judged as, among the items of a labelled url.
MARK = "verdict="
MAX_LISTED, MAX_MINED = 10_000, 1_000  # rules that an expression holds


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct host labels with their level from the right, and path parts with digits made alike."""
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    parts = F.filter(F.split(path, r"[/._-]"), lambda x: x != "")
    return F.array_distinct(
        F.concat(
            F.transform(labels, lambda x, i: F.concat(F.lit("h"), F.least(i, F.lit(3)).cast("string"), F.lit(":"), x)),
            F.transform(parts, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "0"))),
        )
    )


def _map(entries: dict, kind: str) -> Column:
    """A literal map; of a bounded number of entries."""
    if not entries:
        return F.expr(f"cast(map() as map<string,{kind}>)")
    return F.map_from_arrays(F.lit(list(entries)), F.array(*entries.values()))


def listed_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest fitting rule as struct(length, rule, verdict), or null.

    The host's suffixes are looked up in a map by rule host. Of equally long rules the greater text wins.
    """
    if len(rules) > MAX_LISTED:
        raise ValueError(f"more than {MAX_LISTED} rules")
    by_host: dict[str, list] = {}
    for rule_host, rule_path, verdict in rules:
        by_host.setdefault(rule_host, []).append(
            F.struct(
                F.lit(len(rule_host) + len(rule_path)).alias("length"), F.lit(rule_host + rule_path).alias("rule"),
                F.lit(rule_path).alias("path"), F.lit(verdict).alias("verdict"),
            )
        )
    known = _map({h: F.array(*found) for h, found in by_host.items()}, "array<struct<length:int,rule:string,path:string,verdict:string>>")
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fitting = F.flatten(
        F.transform(
            suffixes,
            lambda s: F.filter(
                F.coalesce(F.try_element_at(known, s), F.expr("cast(array() as array<struct<length:int,rule:string,path:string,verdict:string>>)")),
                lambda r: F.startswith(path, r["path"]),
            ),
        )
    )
    return F.array_max(F.transform(fitting, lambda r: F.struct(r["length"].alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """(tokens, verdict, confidence, support) mined from urls with ``tokens`` and ``verdict``.

    A rule stays only if it is surer than every rule of its verdict with fewer of its tokens. All of these stay.
    """
    spark = labelled.sparkSession
    items = labelled.select(F.array_append("tokens", F.concat(F.lit(MARK), "verdict")).alias("items"))
    n = items.count()
    if not n:
        return spark.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=min_support).fit(items)
    is_mark = lambda x: F.startswith(x, F.lit(MARK))
    sets = staged(
        model.freqItemsets.select(
            F.array_sort(F.filter("items", lambda x: ~is_mark(x))).alias("tokens"),
            F.substring(F.get(F.filter("items", is_mark), 0), len(MARK) + 1, 99).alias("verdict"), "freq",
        ).where(F.size("tokens") > 0),
        "token_sets",
    )
    fewer = F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("fewer")
    known = sets.where("verdict is null").select("tokens", F.col("freq").alias("n"))
    # A set of as many urls as one with a token less gives no surer rule; nor does any set that has it within.
    less = known.select(F.col("tokens").alias("fewer"), "n")
    idle = known.where(F.size("tokens") > 1).select("tokens", "n", fewer).join(less, ["fewer", "n"]).select("tokens")
    rules = staged(
        sets.where("verdict is not null").join(known.join(idle, "tokens", "left_anti"), "tokens").select(
            "tokens", "verdict", (F.col("freq") / F.col("n")).alias("confidence"), (F.col("freq") / F.lit(n)).alias("support")
        ),
        "token_rules",
    )
    longest = rules.agg(F.max(F.size("tokens"))).first()[0] or 0
    # Every part of a set is a set too, so the surest part is found by leaving out one token at a time.
    kept, best = None, None
    for size in range(1, longest + 1):
        level = rules.where(F.size("tokens") == size)
        if best is None:
            level = level.withColumn("part", F.lit(-1.0))
        else:
            parts = (
                level.select("tokens", "verdict", fewer).join(best, ["fewer", "verdict"])
                .groupBy("tokens", "verdict").agg(F.max("best").alias("part"))
            )
            level = staged(level.join(parts, ["tokens", "verdict"]), "token_level")
        surer = level.where((F.col("confidence") > F.col("part")) & (F.col("confidence") >= min_confidence)).select(*rules.columns)
        kept = surer if kept is None else kept.union(surer)
        best = level.select(F.col("tokens").alias("fewer"), "verdict", F.greatest("confidence", "part").alias("best"))
    return rules if kept is None else staged(kept, "mined")


def mined_verdict(tokens: Column, rules: list[tuple[list[str], str]]) -> Column:
    """The verdict of the first rule (tokens, verdict) all of whose tokens a url has, or null; rules are found through the index of tokens."""
    if not rules:
        return F.lit(None).cast("string")
    index: dict[str, list[int]] = {}
    for number, (needed, *_) in enumerate(rules):
        for token in needed:
            index.setdefault(token, []).append(number)
    posting = _map({t: F.lit(numbers) for t, numbers in index.items()}, "array<int>")
    hits = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(posting, t), F.expr("cast(array() as array<int>)"))))
    need, verdict = F.lit([len(r[0]) for r in rules]), F.lit([r[1] for r in rules])
    full = F.filter(
        F.array_distinct(hits), lambda n: F.size(F.filter(hits, lambda m: m == n)) == F.element_at(need, n + 1)
    )
    return F.try_element_at(verdict, F.array_min(full) + 1)


def with_mined(judged: DataFrame, rules: DataFrame, max_literal: int = MAX_MINED) -> DataFrame:
    """``judged`` (listed and tokens) with ``mined``: the verdict of the best rule that fits, for rows that no listed one fits.

    The surest rule is the best, then the best supported, the shortest and the first by its tokens. Up to
    ``max_literal`` rules become an index within the expression; more are joined through a table.
    """
    order = [(-F.col("confidence")).alias("unsure"), (-F.col("support")).alias("rare"), F.size("tokens").alias("size"), "tokens", "verdict"]
    ranked = rules.select(F.struct(*order).alias("rule"))
    if rules.count() <= max_literal:
        found = sorted(tuple(r["rule"]) for r in ranked.collect())
        return judged.withColumn("mined", mined_verdict(F.col("tokens"), [(r[3], r[4]) for r in found]))
    # A rule stands at the token that the fewest rules share, so common tokens lead to few of them.
    postings = ranked.select("rule", F.explode("rule.tokens").alias("token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("rules"))
    index = postings.join(shared, "token").groupBy("rule").agg(F.min_by("token", F.struct("rules", "token")).alias("token"))
    asked = judged.where(F.col("listed").isNull()).select("tokens").distinct()
    verdicts = (
        asked.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
        .where(F.size(F.array_except("rule.tokens", "tokens")) == 0)
        .groupBy("tokens").agg(F.min("rule")["verdict"].alias("mined"))
    )
    return judged.join(verdicts, "tokens", "left")


def judge_urls(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    min_support: float = 0.01,
    min_confidence: float = 0.7,
    default: str = "allow",
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row's url.

    ``rule`` is the longest listed rule that fits (null if none) and decides; else the first fitting mined
    rule does, else ``default``. Null urls and urls without ``://`` have empty host and path. Nothing is
    mined when no url fits a listed rule. Repeated rows are judged alike; an empty table gives an empty
    result. Columns besides page_id and url are ignored.
    """
    split = pick(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = split.withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "tokens", url_tokens(F.col("host"), F.col("path"))
    )
    mined = mine_rules(
        judged.where(F.col("listed").isNotNull()).select("tokens", F.col("listed.verdict").alias("verdict")),
        min_support, min_confidence,
    )
    return with_mined(judged, mined).select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", "mined", F.lit(default)).alias("verdict"),
    )
