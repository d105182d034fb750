"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.ann import nearest_neighbours
from sightline.llm.common import table
from sightline.llm.jaccard_join import ngram_jaccard_join
from sightline.llm.line_dedup import dedup_lines
from sightline.llm.mixing import mix_sources
from sightline.llm.packing import best_fit_packing
from sightline.llm.prefix_trie import prefix_trie
from sightline.llm.quality_rules import MEASURES, quality_cascade
from sightline.llm.resampling import importance_resample
from sightline.llm.secret_scan import BASE, find_secrets, span_text
from sightline.llm.topk import exact_top_k
from sightline.llm.toxicity import score_toxicity
from sightline.llm.url_rules import judge_urls
from sightline.llm.warc import archive_round_trip


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(table(spark, folder, "embeddings"), k=20, every=20)


def op4_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"))


def op5_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, folder, "documents"), words=3, similarity=(90, 100))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archive_round_trip(table(spark, folder, "pages"), min_bytes=0)


def op7_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return exact_top_k(table(spark, folder, "embeddings"), k=5, every=50, scale=256)


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = best_fit_packing(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2
    )
    return packed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its lines, how many of them repeat earlier ones, and their numbers."""
    found = dedup_lines(table(spark, folder, "documents"), max_edits=2, min_chars=40)
    return found.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
    )


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents"))
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["rule"] < len(BASE))
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"),
    )


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"), shared=6, group=100)


def op12_importance(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance_resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"), share=(25, 100))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_cascade(table(spark, folder, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_toxicity, op3_nearest, op4_url_rules, op5_ngram_jaccard, op6_warc, op7_exact_top_k,
        op8_packing, op9_line_dedup, op10_secrets, op11_prefix_trie, op12_importance, op13_quality_rules,
    )
}

#: A function of one byte: the table of the usual 32-bit checksum, which DuckDB does not have.
CRC_TABLE = """
            SELECT list(c ORDER BY i) AS t FROM (
                SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
                FROM range(256) r(i)
            )
"""


def crc_sql(text: str) -> str:
    """The unsigned checksum of a text's bytes, with the column ``t`` of CRC_TABLE in reach."""
    return f"""xor(4294967295, list_reduce(
                range(0, octet_length(encode({text}))),
                lambda c, k: xor(c >> 8, t[xor(c % 256, ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT) + 1]),
                4294967295
            ))"""


ORACLES: dict[str, str] = {
    "op5_ngram_jaccard": r"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ),
        sets AS MATERIALIZED (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                   ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))))
                   END AS s
            FROM worded
        ),
        classes AS MATERIALIZED (SELECT s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s),
        shingles AS MATERIALIZED (SELECT rep, len(s) AS n, unnest(s) AS g FROM classes),
        links AS MATERIALIZED (
            SELECT a.rep AS x, b.rep AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.rep < b.rep
            WHERE 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
            GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
        ),
        edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (
            SELECT rep AS x, rep AS y FROM classes
            UNION SELECT reach.x, edges.y FROM reach JOIN edges ON edges.x = reach.y
        ),
        components AS (SELECT x AS rep, min(y) AS least FROM reach GROUP BY x)
        SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(least, doc_id) AS component_id
        FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN components USING (rep)
    """,
    "op6_warc": """
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        hashed AS (SELECT page_id, html, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM payloads)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
               -- Four letters of five bits from every five hexadecimal digits.
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM hashed
    """,
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scores AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id
            WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM scores
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
    """,
    "op11_prefix_trie": """
        WITH crc_table AS (""" + CRC_TABLE + """        ),
        ordered AS (
            SELECT conv_id, list(md5(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))
                                 || ':' || length(coalesce(text, ''))
                                 ORDER BY turn NULLS FIRST) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ),
        shares AS (SELECT conv_id, turns, (""" + crc_sql("conv_id::VARCHAR") + """ % 6)::BIGINT AS h FROM ordered CROSS JOIN crc_table),
        rebuilt AS (
            SELECT s.conv_id, list_concat(coalesce(b.turns, [])[1:s.h], s.turns[s.h + 1:len(s.turns)]) AS path
            FROM shares s LEFT JOIN ordered b ON b.conv_id = s.conv_id - s.conv_id % 100
        ),
        prefixes AS (
            SELECT conv_id, len(path) AS whole, d, array_to_string(path[1:d], ',') AS node,
                   CASE WHEN d > 0 THEN array_to_string(path[1:d - 1], ',') END AS parent,
                   CASE WHEN d > 0 THEN split_part(path[d], ':', 2)::BIGINT ELSE 0 END AS chars
            FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM rebuilt)
        ),
        nodes AS (
            SELECT node, d, parent, min(conv_id) AS least, count(*) AS n, any_value(chars) AS chars,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole = d), '')) AS ends
            FROM prefixes GROUP BY node, d, parent
        ),
        kids AS (SELECT parent, count(*) AS n_children FROM nodes GROUP BY parent),
        facts AS (
            SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.parent = nodes.node
        ),
        under AS (
            SELECT DISTINCT up.node AS top, p.node AS node
            FROM prefixes p JOIN prefixes up ON up.conv_id = p.conv_id AND up.d <= p.d
        ),
        sums AS (
            SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * chars)::BIGINT AS saved
            FROM under JOIN facts USING (node) GROUP BY top
        )
        SELECT f.least AS conv_id, f.d AS depth, a.least AS parent_conv_id, f.n AS n_convs, f.n_children,
               n_leaves, saved AS saved_tokens, f.ends AS ends_sha256
        FROM facts f JOIN sums ON sums.top = f.node LEFT JOIN nodes a ON a.node = f.parent
    """,
    "op12_importance": r"""
        WITH crc_table AS (""" + CRC_TABLE + r"""        ),
        texts AS (
            SELECT row_number() OVER () AS row_no, of_docs, doc_id,
                   regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'
                   ) AS w
            FROM (SELECT true AS of_docs, doc_id, text FROM documents UNION ALL SELECT false, NULL, text FROM benchmark)
        ),
        features AS (
            SELECT row_no, of_docs, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature
            FROM texts
        ),
        per_row AS (SELECT row_no, of_docs, feature, count(*) AS n FROM features GROUP BY ALL),
        names AS (
            SELECT feature, """ + crc_sql("feature") + r""" % 10000 AS bucket
            FROM (SELECT DISTINCT feature FROM per_row) CROSS JOIN crc_table
        ),
        hashed AS (SELECT row_no, of_docs, bucket, sum(n)::BIGINT AS n FROM per_row JOIN names USING (feature) GROUP BY ALL),
        totals AS (
            SELECT bucket, coalesce(sum(n) FILTER (of_docs), 0) AS s, coalesce(sum(n) FILTER (NOT of_docs), 0) AS t FROM hashed GROUP BY bucket
        ),
        gains AS (
            SELECT bucket, floor(1000 * ln(
                ((t + 1) * ((SELECT sum(s) FROM totals) + 10000))::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM totals) + 10000))::DOUBLE
            ))::BIGINT AS gain
            FROM totals
        ),
        weights AS (
            SELECT row_no, sum(n)::BIGINT AS n_features, (sum(n * gain) - ((sum(n * gain) % sum(n)) + sum(n)) % sum(n)) // sum(n) AS weight
            FROM hashed JOIN gains USING (bucket) WHERE of_docs GROUP BY row_no
        ),
        scored AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(w) >= 20 AS enough,
                   coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(
                       (('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE
                   )))::BIGINT AS score
            FROM texts LEFT JOIN weights USING (row_no) WHERE of_docs
        ),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id NULLS LAST) AS place,
                   25 * count(*) OVER (PARTITION BY enough) // 100 AS drawn
            FROM scored
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= drawn THEN place END AS rank FROM ranked
    """,
    "op13_quality_rules": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ),
        windows AS (
            SELECT row_no, i, array_to_string(words[i:i + 7], ' ') AS w
            FROM (SELECT row_no, words, unnest(range(1, len(words) - 6)) AS i FROM d)
        ),
        twice AS (
            SELECT row_no, i FROM windows QUALIFY count(*) OVER (PARTITION BY row_no, w) > 1
        ),
        covered AS (
            SELECT row_no, count(DISTINCT place) AS n FROM (SELECT row_no, unnest(range(i, i + 8)) AS place FROM twice) GROUP BY row_no
        ),
        m AS (
            SELECT doc_id, len(words) AS n_words,
                   coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
                   coalesce(n, 0) AS n_repeat_words,
                   len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words
            FROM d LEFT JOIN covered USING (row_no)
        )
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
               n_repeat_words::BIGINT AS n_repeat_words,
               n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
               n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words AND 10 * n_symbols <= 3 * n_words
                   AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_letter_words >= 7 * n_words
                   AND 2 * n_dup_lines <= n_lines AS kept
        FROM m
    """,
}
