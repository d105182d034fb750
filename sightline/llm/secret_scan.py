"""Secret scans through a trigram inverted index, with DataFrame functions only.

Every regex is turned into a Boolean query of trigrams that any match must hold: a conjunction of runs,
each run a choice between literal strings. One scan of the texts writes the postings of the trigrams
that the queries name, all of them found by one pattern; postings are intersected per document, and only
the candidates' texts are matched. A bit table of fixed size, broadcast, lets a second scan keep nearly
all other texts out of the shuffle. Rules without mandatory trigrams are matched against every text in
the first scan.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.common import pick, staged


@dataclass(frozen=True)
class Rule:
    """``pattern`` reads the same in Java and Python; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs are maximal, so asking for the length in the pattern finds the same runs.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: Literal strings that one run may stand for, and characters of a class that count as a choice.
MAX_STRINGS, MAX_CLASS = 128, 8
#: Words of 64 bits in the broadcast table of candidates: at most this many rows of two numbers, some 50 MB.
FILTER_WORDS = 1 << 20


def _parts(parsed) -> list[frozenset[str] | None]:
    """The regex as a row of literal choices; None where anything may stand."""
    out: list[frozenset[str] | None] = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out.append(frozenset({chr(arg).lower()}))
        elif name == "IN":
            chars: set[str] | None = set()
            for kind, value in arg:
                if str(kind) == "LITERAL":
                    chars.add(chr(value).lower())
                elif str(kind) == "RANGE" and value[1] - value[0] < MAX_CLASS:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    chars = None
                    break
            out.append(frozenset(chars) if chars and len(chars) <= MAX_CLASS else None)
        elif name == "SUBPATTERN":
            out += _parts(arg[3])
        elif name == "BRANCH":
            choices = [_exact(_parts(branch)) for branch in arg[1]]
            out.append(None if None in choices else frozenset().union(*choices))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            exact = _exact(_parts(inner))
            if (least, most) == (0, 1) and exact is not None:
                out.append(exact | {""})
            elif least:
                out += [*_parts(inner) * min(least, 4), *([] if least == most <= 4 else [None])]
            else:
                out.append(None)
        elif name == "AT":
            continue
        else:
            out.append(None)
    return out


def _exact(parts: list[frozenset[str] | None]) -> frozenset[str] | None:
    if None in parts:
        return None
    whole = frozenset({""})
    for part in parts:
        whole = frozenset(a + b for a, b in itertools.product(whole, part))
        if len(whole) > MAX_STRINGS:
            return None
    return whole


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Runs that must all hold; a run holds if all trigrams of one of its alternatives are there.

    In lower case. Empty if the pattern has no mandatory trigrams.
    """
    runs: list[frozenset[str]] = [frozenset({""})]
    for part in _parts(re._parser.parse(pattern)):
        if part is None:
            runs.append(frozenset({""}))
            continue
        longer = frozenset(a + b for a, b in itertools.product(runs[-1], part))
        runs[-1:] = [longer] if len(longer) <= MAX_STRINGS else [runs[-1], part]
    query = []
    for run in runs:
        choices = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() not in choices:
            query.append(sorted((c for c in choices if not any(o < c for o in choices)), key=sorted))
    return query


def any_trigram(trigrams: list[str]) -> str:
    """A pattern that matches, with no width, wherever one of the trigrams begins; group 1 is the trigram."""
    tails: dict[str, list[str]] = {}
    for t in sorted(trigrams):
        tails.setdefault(t[0], []).append(re.escape(t[1:]))
    heads = "".join(re.escape(head) for head in tails)
    return f"(?=[{heads}])(?=({'|'.join(f'{re.escape(h)}(?:{"|".join(rest)})' for h, rest in tails.items())}))"


def _lengths(text: Column, rule: Rule) -> Column:
    """Per match the characters before it since the last match, its own, and its group's."""
    pattern = F.lit(rule.pattern)
    size = lambda x: F.length(x)
    between = F.transform(F.split(text, rule.pattern, -1), size)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), size)
    group = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), size) if rule.group else whole
    zipped = F.transform(
        F.filter(F.arrays_zip(between.alias("gap"), whole.alias("own"), group.alias("part")), lambda x: x["own"].isNotNull()),
        lambda x: F.struct(x["gap"].alias("gap"), x["own"].alias("own"), x["part"].alias("part")),
    )
    return F.when(F.regexp_like(text, pattern), zipped).otherwise(F.array().cast(_HITS))


_HITS = "array<struct<gap:int,own:int,part:int>>"


def _matched(text: Column, rules: list[tuple[int, Rule]], wanted: Column | None = None) -> Column:
    """array of (rule number, lengths of its matches), of the wanted rules that match."""
    found = [
        F.struct(
            F.lit(number).alias("rule"),
            (
                _lengths(text, rule) if wanted is None
                else F.when(F.array_contains(wanted, F.lit(number)), _lengths(text, rule)).otherwise(F.array().cast(_HITS))
            ).alias("hits"),
        )
        for number, rule in rules
    ]
    return F.filter(F.array(*found), lambda x: F.size(x["hits"]) > 0)


def find_secrets(docs: DataFrame, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """Every match of every rule in every whole text, leftmost and non-overlapping per rule.

    Returns per row doc_id and ``found``: array of (start, rule, end, kind) by start, then rule, with rule
    the number in ``base + added`` and positions in code points, end exclusive. A null text is empty and
    has none. Rows that repeat a document repeat its matches; rows without doc_id are scanned like others;
    an empty table gives an empty result. Columns besides doc_id and text are ignored.
    """
    rules = list(enumerate([*base, *added]))
    queries = {number: trigram_query(rule.pattern) for number, rule in rules}
    indexed = [(n, r) for n, r in rules if queries[n]]
    unindexed = [(n, r) for n, r in rules if not queries[n]]
    wanted = sorted({t for q in queries.values() for run in q for choice in run for t in choice})

    def keyed(names: list[str]) -> DataFrame:
        rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        return rows.select("doc_id", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("bytes"), *names)

    present = F.array().cast("array<string>")
    if wanted:
        present = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(any_trigram(wanted)), F.lit(1)))
    scanned = staged(
        keyed(["text"]).select("doc_id", "hash", "bytes", present.alias("trigrams"), _matched(F.col("text"), unindexed).alias("matched") if unindexed else F.array().cast(f"array<struct<rule:int,hits:{_HITS}>>").alias("matched")),
        "postings",
    )
    key = ["doc_id", "hash", "bytes"]
    matched = scanned.where(F.size("matched") > 0).dropDuplicates(key).select(*key, F.explode("matched").alias("m"))

    if indexed:
        terms = [
            (number, run_no, choice_no, t, 1 << bit, (1 << len(choice)) - 1, len(queries[number]))
            for number, _ in indexed
            for run_no, run in enumerate(queries[number])
            for choice_no, choice in enumerate(run)
            for bit, t in enumerate(sorted(choice))
        ]
        # As many rows as the rules have trigrams.
        asked = F.broadcast(docs.sparkSession.createDataFrame(terms, "rule int, run int, choice int, trigram string, bit long, mask long, runs int"))
        postings = scanned.select(*key, F.explode("trigrams").alias("trigram"))
        candidates = staged(
            postings.join(asked, "trigram")
            .groupBy(*key, "rule", "run", "choice", "mask", "runs").agg(F.bit_or("bit").alias("bits"))
            .where(F.col("bits") == F.col("mask"))
            .groupBy(*key, "rule", "runs").agg(F.bit_or(F.expr("shiftleft(cast(1 as bigint), run)")).alias("held"))
            .where(F.bit_count("held") == F.col("runs"))
            .groupBy(*key).agg(F.collect_set("rule").alias("rules")),
            "candidates",
        )
        # Bits that candidates set; a text whose bit is not set is none. Few others pass, and the join drops them.
        word, bit = F.shiftrightunsigned("hash", 6) % FILTER_WORDS, F.col("hash").bitwiseAND(F.lit(63)).cast("int")
        bits = candidates.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
        bits = F.broadcast(bits.groupBy("word").agg(F.bit_or("bit").alias("mask")))
        likely = keyed(["text"]).withColumn("word", word).join(bits, "word").where(F.getbit("mask", bit) == 1)
        named = candidates.select(F.col("doc_id").alias("c_doc"), F.col("hash").alias("c_hash"), F.col("bytes").alias("c_bytes"), "rules")
        texts = likely.select(*key, "text").join(
            named,
            F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("hash") == F.col("c_hash")) & (F.col("bytes") == F.col("c_bytes")),
        )
        verified = (
            texts.select(*key, _matched(F.col("text"), indexed, F.col("rules")).alias("matched"))
            .dropDuplicates(key).select(*key, F.explode("matched").alias("m"))
        )
        matched = matched.unionByName(verified)

    kinds, least = F.lit([r.kind for _, r in rules]), F.lit([r.least for _, r in rules])
    order = Window.partitionBy(*key, "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        matched.select(*key, F.col("m.rule").alias("rule"), F.posexplode("m.hits").alias("at", "hit"))
        .withColumn("end", F.sum(F.col("hit.gap").cast("long") + F.col("hit.own")).over(order))
        .where(F.col("hit.part") >= F.element_at(least, F.col("rule") + 1))
        .groupBy(*key)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        (F.col("end") - F.col("hit.own")).alias("start"), "rule", "end",
                        F.element_at(kinds, F.col("rule") + 1).alias("kind"),
                    )
                )
            ).alias("found")
        )
        .select(F.col("doc_id").alias("s_doc"), F.col("hash").alias("s_hash"), F.col("bytes").alias("s_bytes"), "found")
    )
    return scanned.select(*key).join(
        spans,
        F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("hash") == F.col("s_hash")) & (F.col("bytes") == F.col("s_bytes")),
        "left",
    ).select(
        "doc_id",
        F.coalesce("found", F.array().cast("array<struct<start:bigint,rule:int,end:bigint,kind:string>>")).alias("found"),
    )


def span_text(found: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
