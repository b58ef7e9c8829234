"""Tokens, chunks, detection, overlap resolution and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import logical_split
from ..operators.detect import RuleDetector, apply_threshold, coalesce_label, detect, detect_in_document, rebase_spans
from ..operators.overlap import redact, resolve_overlaps
from ..operators.tokens import (
    chunk_spans,
    chunk_text,
    tokenize,
    truncate_tokens,
    word_spans,
    word_spans_of,
    word_tokens,
)
from ..plans.redact import redact_documents
from ..sources.tables import documents, spread, table
from . import REGISTRY, sql

add = REGISTRY.add


@add("c1_tokenize", sql.with_(sql.DOCS, sql.TOKENS, body='SELECT doc_id, token_idx, "start", "end", text FROM tok'))
def c1(spark, sf):
    return tokenize(documents(spark, sf))


@add(
    "c2_word_spans",
    sql.with_(
        sql.DOCS, sql.TOKENS, sql.WORDS,
        body='SELECT doc_id, word_id, min("start") AS "start", max("end") AS "end" FROM wtok GROUP BY 1, 2',
    ),
)
def c2(spark, sf):
    return word_spans(documents(spark, sf))


@add(
    "c2_word_spans_from_tokens",
    sql.with_(
        sql.DOCS, sql.TOKENS, sql.WORDS,
        body='SELECT doc_id, word_id, min("start") AS "start", max("end") AS "end" FROM wtok GROUP BY 1, 2',
    ),
)
def c2_stored(spark, sf):
    return word_spans_of(word_tokens(documents(spark, sf)).select("doc_id", "word_id", "start", "end"))


@add(
    "c3_truncate_tokens",
    sql.with_(sql.DOCS, sql.TOKENS, body='SELECT doc_id, token_idx, "start", "end" FROM tok WHERE token_idx < 510'),
)
def c3(spark, sf):
    return truncate_tokens(tokenize(documents(spark, sf))).drop("text")


def _candidates(end: str) -> str:
    return ", ".join(
        f"CASE WHEN strpos(rev, {sql.chars(s[::-1])}) > 0 THEN {end} + 1 - strpos(rev, {sql.chars(s[::-1])}) END"
        for s in sql.SEPARATORS
    )


@add(
    "c4_logical_split",
    f"""SELECT doc_id, "end", CAST(coalesce({_candidates('"end"')}, "end") AS INT) AS split_at
        FROM (SELECT *, reverse(substring(text, greatest("end" - 80, 0) + 1, "end" - greatest("end" - 80, 0))) AS rev
              FROM (SELECT doc_id, text, CAST(unnest([length(text), length(text) // 2, length(text) // 3]) AS INT) AS "end"
                    FROM documents))""",
)
def c4(spark, sf):
    docs = documents(spark, sf)
    n = F.length("text")
    ends = docs.select(
        "doc_id", "text",
        F.explode(F.array(n, F.floor(n / 2).cast("int"), F.floor(n / 3).cast("int"))).alias("end"),
    )
    return ends.select("doc_id", "end", logical_split(F.col("text"), F.col("end")).alias("split_at"))


@add(
    "c5_chunk_spans",
    sql.with_(*sql.CHUNK_MEMBERS, body='SELECT doc_id, chunk_id, "start", "end" FROM chunks', recursive=True),
)
def c5(spark, sf):
    return chunk_spans(documents(spark, sf))


@add(
    "c6_chunk_text",
    sql.with_(*sql.CHUNK_MEMBERS, body='SELECT doc_id, chunk_id, "start", "end", text FROM chunk_texts', recursive=True),
)
def c6(spark, sf):
    return chunk_text(documents(spark, sf))


@add(
    "c6_rebase_spans",
    sql.with_(
        *sql.RESOLVED_MEMBERS[:4],
        body="""SELECT s.doc_id, s.chunk_id, CAST(s."start" + c."start" AS INT) AS "start",
                CAST(s."end" + c."start" AS INT) AS "end", s.label
                FROM rel_spans s JOIN chunks c USING (doc_id, chunk_id)""",
        recursive=True,
    ),
)
def c6_rebase(spark, sf):
    docs = documents(spark, sf)
    found = detect(chunk_text(docs), RuleDetector())
    return rebase_spans(found, chunk_spans(docs)).select("doc_id", "chunk_id", "start", "end", "label")


@add(
    "d2_rule_detector",
    sql.with_(*sql.MASK_MEMBERS, body='SELECT doc_id, "start", "end", label, score FROM whole_spans'),
)
def d2(spark, sf):
    docs = documents(spark, sf).withColumn("chunk_id", F.lit(0))
    return detect(docs, RuleDetector()).select("doc_id", "start", "end", "label", "score")


_PAGES = "docs AS (SELECT page_id AS doc_id, html AS text FROM pages)"


@add(
    "d2_rule_detector_pages",
    sql.with_(
        _PAGES, sql.rule_spans("whole_spans", "docs"),
        body='SELECT doc_id AS page_id, "start", "end", label, score FROM whole_spans',
    ),
)
def d2_pages(spark, sf):
    pages = spread(table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))
    found = detect(pages.withColumn("chunk_id", F.lit(0)), RuleDetector())
    return found.select(F.col("doc_id").alias("page_id"), "start", "end", "label", "score")


# The parts of a keyed text, in order: what stands there, and the label it must get.
# Stated apart from the rules, so that a wrong rule cannot agree with itself.
_LETTERS = "translate(CAST({} AS VARCHAR), '0123456789', 'abcdefghij')"
_KEYED = [
    ("'username = '", "NULL"),
    ("'usr' || " + _LETTERS.format("user_id"), "'USERNAME'"),
    ("'; user: '", "NULL"),
    ("'bob_' || " + _LETTERS.format("event_id"), "'USERNAME'"),
    ("""', login="'""", "NULL"),
    ("'amy.' || " + _LETTERS.format("user_id"), "'USERNAME'"),
    ("""'" '""", "NULL"),
    ("repeat('7', CAST(6 + event_id % 25 AS INT))", "CASE WHEN event_id % 25 >= 6 THEN 'IDCARD' END"),
    ("' malevolent, '", "NULL"),
    ("'female'", "'SEX'"),
    ("' '", "NULL"),
    ("repeat('l', CAST(60 + event_id % 20 AS INT)) || '@mail.example.org'", "'EMAIL'"),
    ("' '", "NULL"),
    ("'1.2.3.' || CAST(event_id % 2000 AS VARCHAR)", "CASE WHEN event_id % 2000 <= 999 THEN 'IP' END"),
    ("' end '", "NULL"),
    # Longer runs that hold values: masked whole, or value by value.
    ("'1-555-123-4567'", "'TEL'"),
    ("' '", "NULL"),
    ("'+1 555-123-' || CAST(1000 + event_id % 9000 AS VARCHAR)", "'TEL'"),
    ("' '", "NULL"),
    ("'(555) 123-4567'", "'TEL'"),
    ("' '", "NULL"),
    ("'2024-01-02'", "'DATE'"),
    ("'/'", "NULL"),
    ("'2024-01-05'", "'DATE'"),
    ("' '", "NULL"),
    ("'2024-01-02'", "'DATE'"),
    ("'-'", "NULL"),
    ("'2024-01-05'", "'DATE'"),
    ("' '", "NULL"),
    ("'123-45-67890'", "'POSTCODE'"),
    ("' '", "NULL"),
    ("'555-123-45678'", "'POSTCODE'"),
    ("' '", "NULL"),
    ("'1.2.3.4.' || CAST(event_id AS VARCHAR)", "'IP'"),
    ("' '", "NULL"),
    ("'10:30:15:00'", "'TIME'"),
    ("' '", "NULL"),
    ("'12345-678'", "'POSTCODE'"),
    ("' '", "NULL"),
    ("'4111-1111-1111-' || CAST(1000 + event_id % 9000 AS VARCHAR)", "'IDCARD'"),
    ("' 1234-5678-90 and 5555-555-0100'", "NULL"),
]


def _keyed_sql() -> str:
    parts = "UNION ALL ".join(
        f"SELECT event_id, {i} AS i, {text} AS part, CAST({label} AS VARCHAR) AS label FROM events " for i, (text, label) in enumerate(_KEYED)
    )
    return f"""WITH parts AS ({parts}),
      placed AS (SELECT *, CAST(sum(length(part)) OVER (PARTITION BY event_id ORDER BY i) AS INT) AS "end" FROM parts)
    SELECT event_id, CAST("end" - length(part) AS INT) AS "start", "end", label FROM placed WHERE label IS NOT NULL"""


@add("d2_rules_on_keyed_text", _keyed_sql())
def d2_keyed(spark, sf):
    """Names after keys, digit runs of every length, long local parts, values inside longer ones."""
    spoken = " || ".join(text for text, _ in _KEYED).replace("AS VARCHAR", "AS STRING")
    rows = spread(table(spark, sf, "events")).select("event_id", F.expr(spoken).alias("text"))
    found = detect(rows.withColumn("doc_id", F.col("event_id")).withColumn("chunk_id", F.lit(0)), RuleDetector())
    return found.select(F.col("doc_id").alias("event_id"), "start", "end", "label")


@add(
    "d1_detect_chunks",
    sql.with_(
        *sql.RESOLVED_MEMBERS[:4],
        body='SELECT doc_id, chunk_id, "start", "end", label, score FROM rel_spans', recursive=True,
    ),
)
def d1(spark, sf):
    return detect(chunk_text(documents(spark, sf)), RuleDetector()).drop("pos")


@add(
    "b8_apply_threshold",
    sql.with_(
        *sql.MASK_MEMBERS, body='SELECT doc_id, "start", "end", label, score FROM whole_spans WHERE score >= 0.8'
    ),
)
def b8(spark, sf):
    return apply_threshold(d2(spark, sf), 0.8)


@add(
    "b8_row_threshold",
    sql.with_(
        *sql.MASK_MEMBERS,
        body="""SELECT s.doc_id, s."start", s."end", s.label, s.score
                FROM whole_spans s LEFT JOIN labels l USING (doc_id)
                WHERE s.score >= CASE WHEN l.quality = 1 THEN 0.9 ELSE 0.3 END""",
    ),
)
def b8_row(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    limit = F.when(F.col("quality") == 1, 0.9).otherwise(0.3)
    spans = d2(spark, sf).join(labels, "doc_id", "left").withColumn("threshold", limit)
    return apply_threshold(spans, "threshold").drop("quality", "threshold")


@add(
    "b9_coalesce_label",
    sql.with_(
        *sql.MASK_MEMBERS,
        body="""SELECT doc_id, "start", "end", coalesce(nullif(entity_group, ''), entity) AS label FROM (
                SELECT doc_id, "start", "end", CASE WHEN label = 'TEL' THEN '' WHEN label = 'IP' THEN NULL
                       ELSE label END AS entity_group,
                       CASE WHEN label = 'IP' THEN NULL ELSE 'B-' || label END AS entity FROM whole_spans)
                WHERE coalesce(nullif(entity_group, ''), entity) IS NOT NULL""",
    ),
)
def b9(spark, sf):
    label = F.col("label")
    preds = d2(spark, sf).select(
        "doc_id", "start", "end",
        F.when(label == "TEL", F.lit("")).when(label != "IP", label).alias("entity_group"),
        F.when(label != "IP", F.concat(F.lit("B-"), label)).alias("entity"),
    )
    return coalesce_label(preds)


@add(
    "e1_resolve_overlaps",
    sql.with_(
        *sql.RESOLVED_MEMBERS, body='SELECT doc_id, "start", "end", label, score FROM resolved', recursive=True
    ),
)
def e1(spark, sf):
    return resolve_overlaps(_document_spans(spark, sf)).drop("chunk_id", "pos")


def _document_spans(spark, sf):
    """Spans of all chunks in document offsets, as a table."""
    found = detect_in_document(chunk_text(documents(spark, sf)), RuleDetector())
    return apply_threshold(found, 0.3)


@add(
    "e2_redact",
    sql.with_(
        *sql.RESOLVED_MEMBERS, sql.REDACTED,
        body="SELECT doc_id, redacted, entity_count FROM redacted", recursive=True,
    ),
)
def e2(spark, sf):
    spans = resolve_overlaps(_document_spans(spark, sf))
    return redact(documents(spark, sf).drop("lang"), spans).drop("text")


_E3 = sql.with_(
    *sql.RESOLVED_MEMBERS, sql.REDACTED,
    body="""SELECT r.doc_id, r.redacted, r.entity_count, coalesce(e.entities, '') AS entities
            FROM redacted r LEFT JOIN (
              SELECT s.doc_id, string_agg(s.label || ':' || s."start" || ':' || s."end" || ':'
                       || substring(d.text, s."start" + 1, s."end" - s."start"), '|' ORDER BY s."start") AS entities
              FROM resolved s JOIN docs d USING (doc_id) GROUP BY s.doc_id) e USING (doc_id)""",
    recursive=True,
)


def entity_line(entities):
    return F.array_join(
        F.transform(
            entities,
            lambda e: F.concat_ws(":", e["label"], e["start"].cast("string"), e["end"].cast("string"), e["text"]),
        ),
        "|",
    )


@add("e3_redact_documents", _E3)
def e3(spark, sf):
    out = redact_documents(documents(spark, sf))
    return out.select("doc_id", "redacted", "entity_count", entity_line(F.col("entities")).alias("entities"))


_CHAT = "docs AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"


@add(
    "e3_redact_conversations",
    sql.with_(
        _CHAT, *sql.RESOLVED_MEMBERS[1:], sql.REDACTED,
        body="""SELECT doc_id // 1000 AS conv_id, doc_id % 1000 AS turn, redacted, entity_count FROM redacted""",
        recursive=True,
    ),
)
def e3_chat(spark, sf):
    turns = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    return redact_documents(turns).select("conv_id", "turn", "redacted", "entity_count")
