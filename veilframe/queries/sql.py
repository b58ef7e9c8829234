"""DuckDB building blocks shared by the oracle queries.

Each function returns one ``name AS (...)`` member of a WITH list.
"""

from __future__ import annotations

# Fixed values, stated apart from the operators so that a wrong one cannot agree with itself:
# the token form, where chunks may end, and the forms of personal data.
WS = r" \t\n\f\r"
TOKEN = r"[ \t\n\f\r]*(?:[\p{L}\p{N}_]+|[^ \t\n\f\r\p{L}\p{N}_])"
SEPARATORS = ["\n\n", "\n", ". ", "? ", "! "]
# Label, score, what stands before, the run that counts only as a whole, the value.
WORD_RULES = {
    0: ("EMAIL", 0.99, "", r"[\w.%+-]+(?:@[A-Za-z0-9.-]+\.[A-Za-z]{2,})?", r"[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    8: ("GEOCOORD", 0.9, "", r"[+-]?\d+\.\d+, ?[+-]?\d+\.\d+|\d+", r"[+-]?\d{1,2}\.\d{3,}, ?[+-]?\d{1,3}\.\d{3,}"),
    9: ("PASS", 0.9, '(?:token|password|passwd|secret) *[=:] *"?', r'[^ \t\n\f\r"]{6,}', ".*"),
    10: ("USERNAME", 0.6, '(?:username|user|login) *[=:] *"?', r"[\w.-]{3,}", ".*"),
    11: ("TITLE", 0.5, r"^|[^\p{L}]", r"(?:Mr|Mrs|Ms|Dr|Prof)\.", ".*"),
    12: ("SEX", 0.35, "", r"\p{L}+", "[Mm]ale|[Ff]emale"),
}
# Runs of digits and joints; in the forms of their values a group of digits is <...>.
NUMBER_RUN = r"(?:\+?\d{1,3}[ -]?\(\d+\) ?|\+\d+[ -]?|\(\d+\) ?)?\d[\d./:-]*(?: ?[AaPp][Mm])?"
NUMBER_RULES = {
    1: ("IP", 0.95, r"<\d{1,3}>\.<\d{1,3}>\.<\d{1,3}>\.<\d{1,3}>"),
    2: ("TEL", 0.9, r"(?:\+?<\d{1,3}>[ -]?)?(?:\(<\d{3}>\) ?|<\d{3}>-)<\d{3}>-<\d{4}>"),
    3: ("SOCIALNUMBER", 0.85, r"<\d{3}>-<\d{2}>-<\d{4}>"),
    4: ("IDCARD", 0.8, r"<\d{12,}>|<\d{4}>-<\d{4}>-<\d{4}>-<\d{4}>"),
    5: ("DATE", 0.7, r"<\d{4}>-<\d{2}>-<\d{2}>|<\d{1,2}>/<\d{1,2}>/<\d{2,4}>"),
    6: ("TIME", 0.65, r"<\d{1,2}>:<\d{2}>(?::<\d{2}>)?(?: ?[AaPp][Mm])?"),
    7: ("POSTCODE", 0.4, r"<\d{5}>(?:-<\d{4}>)?"),
}


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pattern(regex: str) -> str:
    """Regexes use the two-character escapes RE2 reads itself."""
    return quote(regex)


def chars(text: str) -> str:
    """A string literal whose line breaks are built with chr."""
    return "||".join(f"chr({ord(c)})" for c in text)


def with_(*members: str, body: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(members) + "\n" + body


DOCS = "docs AS (SELECT doc_id, text, lang FROM documents)"

TOKENS = f"""
tok AS (
  SELECT doc_id, CAST(i - 1 AS INT) AS token_idx, t AS text,
         CAST(sum(length(t)) OVER w - length(t) AS INT) AS "start",
         CAST(sum(length(t)) OVER w AS INT) AS "end"
  FROM (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, {pattern(TOKEN)}, 0) AS ts FROM docs))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""

WORDS = f"""
wtok AS (
  SELECT *, min("start") OVER p AS word_start, max("end") OVER p AS word_end
  FROM (SELECT *, CAST(sum(CASE WHEN token_idx = 0 OR regexp_matches(text, {pattern('^[' + WS + ']')}) THEN 1 ELSE 0 END)
               OVER (PARTITION BY doc_id ORDER BY token_idx) - 1 AS INT) AS word_id FROM tok)
  WINDOW p AS (PARTITION BY doc_id, word_id))"""


def rule_spans(name: str, source: str, extra: str = "") -> str:
    """Spans of the forms above over ``source(doc_id, [extra,] text)``."""
    parts = []
    for pos, (label, score, before, run, value) in WORD_RULES.items():
        p = pattern(f"({before})({run})")
        parts.append(f"""
  SELECT doc_id, {extra} CAST({_upto("i", "found")} - length(vals[i]) AS INT) AS "start", CAST({_upto("i", "found")} AS INT) AS "end",
         {pos} AS pos, {quote(label)} AS label, CAST({score} AS DOUBLE) AS score
  FROM (SELECT doc_id, {extra} unnest(range(1, len(found) + 1)) AS i, gaps, found, vals
        FROM (SELECT doc_id, {extra} string_split_regex(text, {p}) AS gaps,
                     regexp_extract_all(text, {p}, 0) AS found,
                     regexp_extract_all(text, {p}, 2) AS vals
              FROM {source} WHERE regexp_matches(text, {p})))
  WHERE regexp_full_match(vals[i], {pattern(value)}, 's')""")
    parts.append(_number_spans(source, extra))
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


def _upto(i: str, found: str) -> str:
    """Characters up to the end of match ``i``."""
    return f"""list_sum(list_transform(gaps[1:{i}], lambda x: length(x))) + list_sum(list_transform({found}[1:{i}], lambda x: length(x)))"""


def _number_spans(source: str, extra: str) -> str:
    """Per run its values in order; digits between values go to the one before them, the first ones to the first."""
    run, values = pattern(NUMBER_RUN), pattern("|".join(form for _, _, form in NUMBER_RULES.values()))

    def facts(i: int) -> str:
        tests = [f"WHEN regexp_full_match(m, {pattern(form)}) THEN {quote(str((pos, label, score)[i]))}" for pos, (label, score, form) in NUMBER_RULES.items()]
        return "CASE " + " ".join(tests) + " END"

    return f"""
  SELECT doc_id, {extra}
         CAST(run_at + CASE WHEN j = 1 AND regexp_matches(gs[1], '[0-9]') THEN 0 ELSE before END AS INT) AS "start",
         CAST(run_at + before + length(regexp_replace(m, '[<>]', '', 'g'))
              + length(regexp_replace(regexp_extract(gs[j + 1], '^.*[0-9]'), '[<>]', '', 'g')) AS INT) AS "end",
         CAST({facts(0)} AS INT) AS pos, {facts(1)} AS label, CAST({facts(2)} AS DOUBLE) AS score
  FROM (SELECT *, ms[j] AS m,
               length(regexp_replace(array_to_string(gs[1:j], '') || array_to_string(ms[1:j - 1], ''), '[<>]', '', 'g')) AS before
        FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS j
              FROM (SELECT *, regexp_extract_all(mark, {values}) AS ms, string_split_regex(mark, {values}) AS gs
                    FROM (SELECT doc_id, {extra} {_upto("i", "found")} - length(found[i]) AS run_at,
                                 regexp_replace(found[i], '([0-9]+)', '<\\1>', 'g') AS mark
                          FROM (SELECT doc_id, {extra} unnest(range(1, len(found) + 1)) AS i, gaps, found
                                FROM (SELECT doc_id, {extra} string_split_regex(text, {run}) AS gaps, regexp_extract_all(text, {run}, 0) AS found
                                      FROM {source}))))))"""


MASKS = """
masks AS (
  SELECT doc_id, "start", "end", label, score, pos,
         CAST(row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", pos) - 1 AS INT) AS mask_idx
  FROM whole_spans)"""

# docs -> tokens -> chunks, following the fold step by step
CHUNKS = f"""
arr AS (
  SELECT doc_id, any_value(d.text) AS text, list(t."end" ORDER BY t.token_idx) AS ends, count(*) AS n
  FROM tok t JOIN docs d USING (doc_id) GROUP BY doc_id HAVING count(*) > 512),
walk(doc_id, chunk_id, first, stop) AS (
  SELECT doc_id, -1, -1, 256 FROM arr
  UNION ALL
  SELECT doc_id, chunk_id + 1, nf,
         CASE WHEN stop0 >= n THEN stop0
              WHEN (CASE WHEN nf = 0 THEN 0 ELSE ends[nf] END) > cand THEN stop0
              ELSE stop0 - len(list_filter(range(nf, stop0),
                     lambda t: (CASE WHEN t = 0 THEN 0 ELSE ends[t] END) > cand)) END
  FROM (SELECT *, coalesce({', '.join(
      f"CASE WHEN strpos(rev, {chars(sep[::-1])}) > 0 THEN ends[stop0] + 1 - strpos(rev, {chars(sep[::-1])}) END"
      for sep in SEPARATORS)}, ends[stop0]) AS cand
    FROM (SELECT *, reverse(substring(text, greatest(ends[stop0] - 80, 0) + 1,
                                      ends[stop0] - greatest(ends[stop0] - 80, 0))) AS rev
      FROM (SELECT *, CAST(least(nf + 510, n) AS INT) AS stop0
        FROM (SELECT c.doc_id, c.chunk_id, a.text, a.ends, a.n,
                     CASE WHEN c.stop - 256 <= c.first THEN c.first + 1 ELSE c.stop - 256 END AS nf
              FROM walk c JOIN arr a USING (doc_id) WHERE c.stop < a.n))))),
chunks AS (
  SELECT w.doc_id, CAST(chunk_id AS INT) AS chunk_id,
         CAST(CASE WHEN first = 0 THEN 0 ELSE a.ends[first] END AS INT) AS "start",
         CAST(CASE WHEN stop >= a.n THEN length(a.text) ELSE a.ends[stop] END AS INT) AS "end"
  FROM walk w JOIN arr a USING (doc_id) WHERE chunk_id >= 0
  UNION ALL
  SELECT doc_id, 0, 0, CAST(length(text) AS INT) FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM arr)),
chunk_texts AS (
  SELECT c.doc_id, c.chunk_id, c."start", c."end", substring(d.text, c."start" + 1, c."end" - c."start") AS text
  FROM chunks c JOIN docs d USING (doc_id))"""

CHUNK_SPANS = """
doc_spans AS (
  SELECT s.doc_id, s.chunk_id, CAST(s."start" + c."start" AS INT) AS "start",
         CAST(s."end" + c."start" AS INT) AS "end", s.pos, s.label, s.score
  FROM rel_spans s JOIN chunks c USING (doc_id, chunk_id) WHERE s.score >= 0.3)"""


def resolved(source: str) -> str:
    return f"""
resolved AS (
  SELECT doc_id, "start", "end", label, score, chunk_id, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY score DESC, "start", "end", chunk_id, pos) AS rn
    FROM (SELECT *, sum(CASE WHEN reach IS NULL OR "start" >= reach THEN 1 ELSE 0 END)
                   OVER (PARTITION BY doc_id ORDER BY "start", "end", chunk_id, pos) AS grp
          FROM (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end", chunk_id, pos
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
                FROM {source}))) WHERE rn = 1)"""


REDACTED = """
pieces AS (
  SELECT r.doc_id, r."start",
         substring(d.text, prev + 1, r."start" - prev) || '[' || r.label || ']' AS piece, r."end"
  FROM (SELECT *, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY "start"), 0) AS prev FROM resolved) r
  JOIN docs d USING (doc_id)),
redacted AS (
  SELECT d.doc_id, coalesce(any_value(h.head) || substring(d.text, any_value(h.last) + 1), d.text) AS redacted,
         coalesce(any_value(h.n), 0) AS entity_count
  FROM docs d LEFT JOIN (SELECT doc_id, string_agg(piece, '' ORDER BY "start") AS head, max("end") AS last,
                                CAST(count(*) AS INT) AS n FROM pieces GROUP BY doc_id) h USING (doc_id)
  GROUP BY d.doc_id, d.text)"""

CHUNK_MEMBERS = (DOCS, TOKENS, CHUNKS)
RESOLVED_MEMBERS = (
    DOCS, TOKENS, CHUNKS, rule_spans("rel_spans", "chunk_texts", "chunk_id,"), CHUNK_SPANS, resolved("doc_spans"),
)
MASK_MEMBERS = (DOCS, rule_spans("whole_spans", "docs"), MASKS)
SPLIT = "CASE WHEN substring(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '3' THEN 'validation' ELSE 'train' END"


# ---- labels and alignment ----

VOCAB = """
vocab AS (
  SELECT 'O' AS label, 0 AS label_id, CAST(NULL AS VARCHAR) AS entity, 'O' AS bio
  UNION ALL
  SELECT b.bio || '-' || v.label, CAST(1 + 2 * (v.i - 1) + b.k AS INT), v.label, b.bio
  FROM (SELECT label, row_number() OVER (ORDER BY doc_id, mask_idx) AS i FROM (
          SELECT label, doc_id, mask_idx, row_number() OVER (PARTITION BY label ORDER BY doc_id, mask_idx) AS rn
          FROM masks) WHERE rn = 1) v,
       (VALUES ('B', 0), ('I', 1)) b(bio, k))"""

PREDICTED = """
pmasks AS (
  SELECT doc_id, mask_idx, "start", "end" + CASE WHEN h IN ('5', '6') THEN 8 ELSE 0 END AS "end",
         CASE WHEN h IN ('3', '4') THEN 'TEL' ELSE label END AS label
  FROM (SELECT *, substring(md5(doc_id || ':' || "start" || ':' || label), 1, 1) AS h FROM masks) WHERE h > '2')"""


def tagged(name: str, masks: str, mode: str) -> str:
    """Tokens with the tag of ``masks`` under an alignment mode."""
    if mode in ("word_union", "word_union_sticky"):
        before = (
            "lag(ent) OVER (PARTITION BY doc_id ORDER BY token_idx)"
            if mode == "word_union"
            else "last_value(ent IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY token_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        )
        return f"""
{name} AS (
  SELECT doc_id, token_idx, word_id, "start", "end", word_start, word_end, text,
         CASE WHEN ent IS NULL THEN 'O'
              WHEN "start" > word_start OR before = ent THEN 'I-' || ent ELSE 'B-' || ent END AS tag
  FROM (SELECT *, {before} AS before
        FROM (SELECT t.*, m.label AS ent FROM wtok t
              LEFT JOIN (SELECT w.doc_id, w.word_id, max(k.mask_idx) AS mask_idx
                         FROM (SELECT DISTINCT doc_id, word_id, word_start, word_end FROM wtok) w
                         JOIN {masks} k ON w.doc_id = k.doc_id AND w.word_start < k."end" AND w.word_end > k."start"
                         GROUP BY 1, 2) x ON t.doc_id = x.doc_id AND t.word_id = x.word_id
              LEFT JOIN {masks} m ON m.doc_id = x.doc_id AND m.mask_idx = x.mask_idx)))"""
    touch = (
        't."start" >= k."start" AND t."end" <= k."end"'
        if mode == "contain"
        else 't."end" > k."start" AND t."start" < k."end"'
    )
    begins = 't."start" = m."start"' if mode == "contain" else 't."start" <= m."start"'
    return f"""
{name} AS (
  SELECT t.doc_id, t.token_idx, t.word_id, t."start", t."end", t.word_start, t.word_end, t.text,
         CASE WHEN m.label IS NULL THEN 'O' WHEN {begins} THEN 'B-' || m.label ELSE 'I-' || m.label END AS tag
  FROM wtok t
  LEFT JOIN (SELECT t.doc_id, t.token_idx, min(k.mask_idx) AS mask_idx FROM wtok t
             JOIN {masks} k ON t.doc_id = k.doc_id AND {touch} GROUP BY 1, 2) x
         ON t.doc_id = x.doc_id AND t.token_idx = x.token_idx
  LEFT JOIN {masks} m ON m.doc_id = x.doc_id AND m.mask_idx = x.mask_idx)"""


TAG_MEMBERS = (*MASK_MEMBERS, TOKENS, WORDS)

PAIRS = """
pairs AS (SELECT g.doc_id, g.token_idx, g.text, g."start", g.word_start, g.tag AS gold, p.tag AS pred
          FROM gtag g JOIN ptag p ON g.doc_id = p.doc_id AND g.token_idx = p.token_idx),
kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY token_idx) - 1 AS INT) AS i
         FROM pairs WHERE gold = 'O' OR "start" = word_start)"""

PAIR_MEMBERS = (
    *TAG_MEMBERS, PREDICTED, tagged("gtag", "masks", "word_union"), tagged("ptag", "pmasks", "word_union"), PAIRS,
)


def iob_spans(name: str, tag: str) -> str:
    """Lenient IOB spans over the kept tokens."""
    return f"""
{name} AS (
  SELECT doc_id, any_value(typ) AS label, min(i) AS "first", max(i) AS "last"
  FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS grp
        FROM (SELECT doc_id, i, typ, CASE WHEN {tag} LIKE 'B-%' OR before IS NULL OR before <> typ THEN 1 ELSE 0 END AS opens
              FROM (SELECT doc_id, i, {tag}, substring({tag}, 3) AS typ,
                           CASE WHEN lag({tag}) OVER (PARTITION BY doc_id ORDER BY i) <> 'O'
                                THEN substring(lag({tag}) OVER (PARTITION BY doc_id ORDER BY i), 3) END AS before
                    FROM kept) WHERE {tag} <> 'O'))
  GROUP BY doc_id, grp)"""


SPAN_MEMBERS = (*PAIR_MEMBERS, iob_spans("gspans", "gold"), iob_spans("pspans", "pred"))

COUNTS = """
counts AS (
  SELECT coalesce(g.label, p.label) AS label,
         count(*) FILTER (g.label IS NOT NULL AND p.label IS NOT NULL) AS tp,
         count(g.label) AS n_true, count(p.label) AS n_pred
  FROM gspans g FULL JOIN pspans p
    ON g.doc_id = p.doc_id AND g.label = p.label AND g."first" = p."first" AND g."last" = p."last"
  GROUP BY 1),
rates AS (
  SELECT label, tp, n_true, n_pred, precision, recall,
         CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
  FROM (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END AS precision,
                  CASE WHEN n_true > 0 THEN tp / n_true ELSE 0 END AS recall FROM counts))"""
SCORE_MEMBERS = (*SPAN_MEMBERS, COUNTS)
