"""The registered queries of this subpackage; each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (
    alignment, fingerprint, hard_negatives, html_text, jaccard_join, langid, mixing, packing, quality, quotes, token_spans,
    toxicity, warc,
)
from ledgerline.sources.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predict_languages(_table(spark, folder, "documents"))


def op2_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.compare_with_edits(_table(spark, folder, "documents"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return mixing.mix_documents(docs, Workspace(spark, "mixing"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(
        _table(spark, folder, "documents"), _table(spark, folder, "labels")
    )


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge_documents(_table(spark, folder, "documents"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_table(spark, folder, "pages"), Workspace(spark, "warc"))


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    rule = jaccard_join.Rule(words=4, percent=85)
    return jaccard_join.JaccardJoin(docs, Workspace(spark, "jaccard"), rule).classes()


def op8_token_spans(spark: SparkSession, folder: str) -> DataFrame:
    return token_spans.count_tokens(_table(spark, folder, "documents"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def op10_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.link_quotes(_table(spark, folder, "conversations"), Workspace(spark, "quotes"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return alignment.Alignment(docs, Workspace(spark, "alignment")).digests()


def op12_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(_table(spark, folder, "pages"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.HardNegatives(
        rows.withColumn("label", moved), Workspace(spark, "hard-negatives"), F.col("vec_id") % 100 == 0
    ).negatives()


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_fingerprint": op2_fingerprint,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc": op6_warc,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_token_spans": op8_token_spans,
    "op9_packing": op9_packing,
    "op10_quotes": op10_quotes,
    "op11_alignment": op11_alignment,
    "op12_html_text": op12_html_text,
    "op13_hard_negatives": op13_hard_negatives,
}

# Bare upper-case base 32 of SHA-1: five hexadecimal digits are four characters.
OP6_SQL = """
WITH hashed AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), grouped AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload) AS response FROM hashed
)
SELECT
    page_id,
    CAST(strlen(payload) AS BIGINT) AS payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT)
            >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < response THEN response END AS refers_to
FROM grouped
"""

OP10_SQL = r"""
WITH RECURSIVE messages AS (
    SELECT conv_id, turn, role, text, string_split_regex(coalesce(text, ''), '\r?\n') AS parts
    FROM conversations
), numbered AS (
    SELECT row_number() OVER () AS message, * FROM messages
), lines AS (
    SELECT message, conv_id, turn, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no
    FROM numbered
), levelled AS (
    SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level,
        trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*((?:>[ \t]?)+)', '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS plain
    FROM lines
), parted AS (
    SELECT *, sum(CASE WHEN level IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER w AS run,
        sum(CASE WHEN plain = '' THEN 1 ELSE 0 END) OVER w AS gap
    FROM (SELECT *, lag(level) OVER (PARTITION BY message ORDER BY line_no) AS before FROM levelled)
    WINDOW w AS (PARTITION BY message ORDER BY line_no)
), paragraphs AS (
    SELECT message, conv_id, turn, level, run, gap,
        string_agg(replace(plain, ' ', ''), '' ORDER BY line_no) AS paragraph
    FROM parted WHERE plain <> '' GROUP BY message, conv_id, turn, level, run, gap
), neighbours AS (
    SELECT *, lead(paragraph) OVER (PARTITION BY message, run ORDER BY gap) AS next FROM paragraphs
), runs AS (
    SELECT message, conv_id, turn, level, run, string_agg(paragraph, '' ORDER BY gap) AS body
    FROM paragraphs GROUP BY message, conv_id, turn, level, run
), originals AS (
    SELECT conv_id, kind, body, min(turn) AS original
    FROM (
        SELECT conv_id, turn, level, 'passage' AS kind, body FROM runs
        UNION ALL SELECT conv_id, turn, level, 'passage', paragraph FROM paragraphs
        UNION ALL SELECT conv_id, turn, level, 'passage', paragraph || next FROM neighbours WHERE next IS NOT NULL
        UNION ALL SELECT conv_id, turn, level, 'line', plain FROM parted WHERE plain <> ''
    )
    WHERE level = 0 AND conv_id IS NOT NULL AND turn IS NOT NULL
    GROUP BY conv_id, kind, body
), sources AS (
    SELECT l.message, l.level, coalesce(
        CASE WHEN whole.original < l.turn THEN whole.original END,
        CASE WHEN part.original < l.turn THEN part.original END,
        CASE WHEN line.original < l.turn THEN line.original END) AS original
    FROM parted l JOIN runs r USING (message, run) JOIN paragraphs p USING (message, run, gap)
    LEFT JOIN originals whole ON whole.conv_id = l.conv_id AND whole.kind = 'passage' AND whole.body = r.body
    LEFT JOIN originals part ON part.conv_id = l.conv_id AND part.kind = 'passage' AND part.body = p.paragraph
    LEFT JOIN originals line ON line.conv_id = l.conv_id AND line.kind = 'line' AND line.body = l.plain
    WHERE l.level > 0 AND l.plain <> ''
), linked AS (
    SELECT message, level, original, count(*) AS n FROM sources
    WHERE original IS NOT NULL GROUP BY message, level, original
), replies AS (
    SELECT message, sum(n) OVER (PARTITION BY message) AS linked_lines, original AS reply_to
    FROM linked
    QUALIFY row_number() OVER (PARTITION BY message ORDER BY level, n DESC, original DESC) = 1
), links AS (
    SELECT conv_id, turn, max(reply_to) AS reply_to
    FROM replies JOIN numbered USING (message) GROUP BY conv_id, turn
), threads AS (
    SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM links
    UNION ALL
    SELECT t.conv_id, t.turn, l.reply_to, t.depth + 1
    FROM threads t JOIN links l ON l.conv_id = t.conv_id AND l.turn = t.thread
), roots AS (
    SELECT conv_id, turn, min(thread) AS thread, max(depth) AS depth FROM threads GROUP BY conv_id, turn
), own AS (
    SELECT message,
        string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT goes) AS own_text,
        count(*) FILTER (level > 0) AS quoted_lines, max(level) AS deepest_quote
    FROM (SELECT *, level > 0
            OR (regexp_matches(line, '(?i)^.*\b(wrote|writes|said|schrieb|écrit|escribió)\b.*:[ \t]*$')
                AND coalesce(lead(level) OVER (PARTITION BY message ORDER BY line_no) > 0, false)) AS goes
        FROM levelled)
    GROUP BY message
), answered AS (
    SELECT n.conv_id, n.turn, n.role,
        regexp_replace(coalesce(o.own_text, ''), '^\s*\n|\s+$', '', 'g') AS own_text,
        o.quoted_lines, CAST(o.deepest_quote AS BIGINT) AS deepest_quote,
        CAST(coalesce(r.linked_lines, 0) AS BIGINT) AS linked_lines, r.reply_to,
        coalesce(t.thread, n.turn) AS thread, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth
    FROM numbered n JOIN own o USING (message) LEFT JOIN replies r USING (message)
    LEFT JOIN roots t ON t.conv_id = n.conv_id AND t.turn = n.turn
)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn, own_text, role) AS position
FROM answered
"""

# All pairs that share a shingle; classes by walking the links.
OP7_SQL = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda w: w <> '') AS words
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 2),
            lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles
    FROM texts
), sized AS (
    SELECT doc_id, shingles, CAST(len(shingles) AS BIGINT) AS n FROM sets
), parts AS (
    SELECT doc_id, n, unnest(shingles) AS shingle FROM sized
), links AS (
    SELECT x.doc_id AS a, y.doc_id AS b
    FROM parts x JOIN parts y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
        AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
    GROUP BY x.doc_id, y.doc_id, x.n, y.n
    HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), walk AS (
    SELECT doc_id, doc_id AS reached FROM documents
    UNION
    SELECT w.doc_id, l.b FROM walk w JOIN links l ON l.a = w.reached
)
SELECT doc_id, any_value(n) AS n_shingles, min(reached) AS component_id
FROM sized JOIN walk USING (doc_id) GROUP BY doc_id
"""

# For pages that mark their article and hold blocks of headings and paragraphs in it, as the given ones.
OP12_SQL = r"""
WITH articles AS (
    SELECT page_id, url, row_number() OVER () AS page,
        regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS article
    FROM pages
), blocks AS (
    SELECT page, unnest(parts) AS block, generate_subscripts(parts, 1) AS block_no
    FROM (SELECT page, string_split_regex(article, '</?(?:p|h[1-6])>') AS parts FROM articles)
), plain AS (
    SELECT page, block_no, trim(regexp_replace(
        regexp_replace(replace(replace(replace(
            regexp_replace(replace(block, '<br>', ' '), '<[^>]*>', '', 'g'),
            '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'),
        '\s+', ' ', 'g')) AS line
    FROM blocks
), texts AS (
    SELECT page, string_agg(line, chr(10) ORDER BY block_no) FILTER (line <> '') AS text FROM plain GROUP BY page
)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars
FROM articles LEFT JOIN texts USING (page)
"""

OP13_SQL = """
WITH taken AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS alike,
        CAST(list_sum(list_transform(list_zip(a.vector, r.vector), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM taken a JOIN taken r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
    id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op13_hard_negatives": OP13_SQL,
    "op12_html_text": OP12_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op10_quotes": OP10_SQL,
    "op6_warc": OP6_SQL,
}
