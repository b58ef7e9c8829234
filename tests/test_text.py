import random

import pytest
import regex
from pyspark.sql import functions as F

import models
from veilframe.functions.rules import DEFAULT_RULES, Rule, labels
from veilframe.functions.spans import SPANS, resolve_array
from veilframe.functions.text import chunk_array, logical_split, redact_text
from veilframe.operators.detect import (
    RuleDetector,
    apply_threshold,
    coalesce_label,
    detect,
    detect_in_document,
    rebase_spans,
)
from veilframe.operators.overlap import redact, resolve_overlaps
from veilframe.operators.tokens import (
    chunk_spans,
    chunk_text,
    tokenize,
    truncate_tokens,
    word_spans,
    word_spans_of,
    word_tokens,
)
from veilframe.plans.redact import redact_documents

SPAN_ROW = "doc_id long, start int, end int, chunk_id int, pos int, label string, score double"


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def random_text(rng, words):
    parts = []
    for _ in range(words):
        parts.append(rng.choice(["alpha", "é1", "日本", "x_y", "a@b.io", "12.5", "𝒳z", "(", "--", "10.0.0.1"]))
        parts.append(rng.choice([" ", " ", " ", "\n", "\n\n", ". ", "? ", "! ", "", "\t"]))
    return "".join(parts)


def test_tokens_join_back_and_match_model(spark):
    rng = random.Random(1)
    values = [random_text(rng, n) for n in (0, 1, 5, 50, 400)] + ["   ", "", " a", "a  "]
    rows = tokenize(texts(spark, *values)).collect()
    for i, value in enumerate(values):
        mine = sorted((r.token_idx, r.start, r.end, r.text) for r in rows if r.doc_id == i)
        assert [(r[1], r[2]) for r in mine] == models.tokens(value)
        assert value.startswith("".join(r[3] for r in mine))
        assert all(value[r[1]:r[2]] == r[3] for r in mine)


def test_words_cover_their_tokens(spark):
    rows = word_tokens(texts(spark, "foo, bar-baz  qux")).collect()
    assert [(r.text, r.word_id, r.word_start, r.word_end) for r in rows] == [
        ("foo", 0, 0, 4), (",", 0, 0, 4), (" bar", 1, 4, 12), ("-", 1, 4, 12), ("baz", 1, 4, 12), ("  qux", 2, 12, 17),
    ]
    df = texts(spark, "foo, bar-baz  qux", "")
    direct = {tuple(r) for r in word_spans(df).collect()}
    stored = {tuple(r) for r in word_spans_of(word_tokens(df).select("doc_id", "word_id", "start", "end")).collect()}
    assert direct == stored == {(0, 0, 0, 4), (0, 1, 4, 12), (0, 2, 12, 17)}


def test_truncation_happens_before_words(spark):
    df = texts(spark, "aa bb-cc dd")
    assert truncate_tokens(tokenize(df), 5).count() == 3
    rows = word_tokens(df, max_length=5).collect()
    assert [(r.text, r.word_end) for r in rows] == [("aa", 2), (" bb", 6), ("-", 6)]


@pytest.mark.parametrize(
    "text, end, want",
    [("a. b\nc. d", 9, 5), ("a? b. c", 7, 6), ("a? b! c", 7, 3), ("abc", 3, 3), ("a\n\nb\nc", 6, 3), ("", 0, 0)],
)
def test_logical_split(spark, text, end, want):
    got = texts(spark, text).select(logical_split(F.col("text"), F.lit(end))).first()[0]
    assert got == want == models.split_point(text, end)


def test_logical_split_looks_back_no_further(spark):
    text = "a. " + "b" * 100
    assert texts(spark, text).select(logical_split(F.col("text"), F.lit(len(text)))).first()[0] == len(text)


@pytest.mark.parametrize("max_length, stride", [(512, 0.5), (12, 0.5), (5, 0.9), (40, 0.1), (100, 0.99)])
def test_chunks_match_model(spark, max_length, stride):
    rng = random.Random(max_length)
    values = [random_text(rng, n) for n in (0, 3, 30, 90, 700, 1500)] + ["w " * 600, "w" * 900, "\n\n" * 50 + "a b c d e f g"]
    rows = chunk_spans(texts(spark, *values), max_length=max_length, stride=stride).collect()
    for i, value in enumerate(values):
        got = [(r.start, r.end) for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.chunk_id)]
        want = models.chunks(value, max_length, stride)
        assert got == want, (i, got[:5], want[:5])
        assert got[0][0] == 0 and got[-1][1] == len(value)
        assert all(b[0] <= a[1] for a, b in zip(got, got[1:]))


def test_chunk_edges(spark):
    words = " ".join(["w"] * 513)
    rows = chunk_spans(texts(spark, "", " ".join(["w"] * 512), words)).collect()
    by_doc = {i: [(r.start, r.end) for r in rows if r.doc_id == i] for i in range(3)}
    assert by_doc[0] == [(0, 0)] and by_doc[1] == [(0, 1023)]
    assert by_doc[2] == [(0, 1019), (507, 1025)]


def test_chunk_stride_is_checked(spark):
    with pytest.raises(ValueError):
        chunk_array(F.col("text"), F.col("t"), 512, 1.0)


def test_chunk_text_is_the_slice(spark):
    rng = random.Random(9)
    value = random_text(rng, 900) + " \n "
    rows = chunk_text(texts(spark, value), max_length=60).collect()
    assert len(rows) > 10 and all(r.text == value[r.start:r.end] for r in rows)


def test_rules_match_python(spark):
    rng = random.Random(3)
    pieces = [
        "a.b@c.example.org", "10.20.30.40", "+1 (555) 555-0100", "555-555-0100", "078-05-1120", "2024-01-31",
        "1/2/24", "9:30 am", "12345-6789", "48.8584, 2.2945", "4994226020900891", 'token = "deadbeef00"',
        "user=joe_1", "Dr.", "Mr.", "female", "männlich", "Male", "é", "x", "\n", "  ", ".", ",", "-", "/", ":", "(", ")", "+", "7", "123", "5555",
    ]
    values = ["".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(60)) for _ in range(20)]
    values += ["".join(rng.choice("0123-./:+() a") for _ in range(3000)) for _ in range(5)]
    rows = detect(texts(spark, *values).withColumn("chunk_id", F.lit(0)), RuleDetector()).collect()
    got = {(r.doc_id, r.label, r.start, r.end) for r in rows}
    want = {
        (i, rule.label, m.start(2), m.end(2))
        for i, value in enumerate(values)
        for rule in DEFAULT_RULES
        if isinstance(rule, Rule)
        for m in regex.finditer(rule.pattern, value)
        if regex.fullmatch(rule.value, m[2])
    } | {(i, *span) for i, value in enumerate(values) for span in models.numbers(value)}
    assert got == want and len(rows) == len(got) > 300


# Per label a text for each way of writing its context and its value, and texts it must leave.
FORMS = {
    "EMAIL": (["a@b.cc", "x.y%z+1-_@sub.d-e.org", "l" * 300 + "@b.cc"], ["a@b", "@b.cc"]),
    "IP": (["1.2.3.4", "255.255.255.255", "1.2.3.4.5", "1234.5.6.789.10"], ["1.2.3.4567", "1.2.3"]),
    "TEL": (
        ["555-555-0100", "+1 (555) 555-0100", "+442(555)555-0100", "1-555-123-4567", "+1 555-123-4567", "(555) 123-4567", "1 (555) 123-4567"],
        ["555-123-45678", "5555-555-0100", "+1 (555) 555-01000"],
    ),
    "SOCIALNUMBER": (["078-05-1120"], ["078-05-11200", "1078-05-1120"]),
    "DATE": (["2024-01-31", "1/2/24", "11/12/2024", "2024-01-31-7"], ["2024-01-311", "1/2/20244"]),
    "TIME": (["9:30", "09:30:15", "9:30 am", "9:30PM", "10:30:15:00"], ["9:300", "123:30"]),
    "POSTCODE": (["12345", "12345-6789", "12345-678", "123-45-67890", "555-123-45678"], ["123456789", "1234"]),
    "GEOCOORD": (["1.234,5.678", "-48.8584, +2.2945"], ["123.4567, 8.901234", "1.2, 3.4"]),
    "IDCARD": (["123456789012", "1" * 40, "4111-1111-1111-1111"], ["12345678901"]),
    "PASS": ([f'{k}{e}"abcdef' for k in ("token", "password", "passwd", "secret") for e in ("=", ": ", " = ")], ["secret: abc"]),
    "USERNAME": ([f"{k}{e}abc" for k in ("username", "user", "login") for e in ("=", ": ", " = ")], ["user: ab"]),
    "TITLE": (["Mr.", "Mrs.", "Ms.", "Dr.", "Prof."], ["aMr.", "Mr"]),
    "SEX": (["male", "Male", "female", "Female"], ["malevolent", "females", "tamale"]),
}


def test_every_form_is_found_whole(spark):
    assert set(FORMS) == set(labels())
    rows = [(label, text, k == 0) for label, both in FORMS.items() for k in (0, 1) for text in both[k]]
    found = detect(texts(spark, *[f"é {r[1]} x" for r in rows]).withColumn("chunk_id", F.lit(0)), RuleDetector()).collect()
    spans = {(r.doc_id, r.label): (r.start, r.end) for r in found}
    for i, (label, text, good) in enumerate(rows):
        assert ((i, label) in spans) == good, (label, text)
        if good:
            start, end = spans[i, label]
            assert end == 2 + len(text) and (start == 2 or label in ("PASS", "USERNAME")), (label, text)


def test_runs_keep_no_value_in_clear(spark):
    runs = ["2024-01-02/2024-01-05", "2024-01-02-2024-01-05", "12345-67890", "9:30-10:30 pm", "1.2.3.4/24"]
    rows = redact_documents(texts(spark, *runs)).orderBy("doc_id").collect()
    assert [r.redacted for r in rows] == ["[DATE]/[DATE]", "[DATE]-[DATE]", "[POSTCODE]-[POSTCODE]", "[TIME]-[TIME]", "[IP]"]
    long = ["1-" * 20000 + "12345", "12345" + "-" * 100000 + "1"]  # one run each, far longer than a chunk
    found = detect(texts(spark, *long).withColumn("chunk_id", F.lit(0)), RuleDetector()).orderBy("doc_id").collect()
    assert [(r.label, r.start, r.end) for r in found] == [("POSTCODE", 0, len(t)) for t in long]


def test_groups_behind_an_address_are_no_values(spark):
    rows = ["1.2.3.4.10020", "1.2.3.4.123456789012", "1.2.3.4.10020.5-1", "1.2.3.4.9999", "1.2.3.4/10020"]
    found = detect(texts(spark, *rows).withColumn("chunk_id", F.lit(0)), RuleDetector()).orderBy("doc_id", "start").collect()
    whole = [(i, 0, len(t), "IP") for i, t in enumerate(rows[:4])]
    assert [(r.doc_id, r.start, r.end, r.label) for r in found] == [*whole, (4, 0, 7, "IP"), (4, 8, 13, "POSTCODE")]


def test_own_catalogue(spark):
    detector = RuleDetector([Rule("STREET", "[0-9]+ Main St", 0.7)])
    df = texts(spark, "at 12 Main St, not 13 Side St").withColumn("chunk_id", F.lit(0))
    assert [(r.label, r.start, r.end) for r in detect(df, detector).collect()] == [("STREET", 3, 13)]


def test_many_matches_in_one_text(spark):
    value = "1.2.3.4 " * 3000
    rows = detect(texts(spark, value).withColumn("chunk_id", F.lit(0)), RuleDetector()).where("label = 'IP'").collect()
    assert sorted(r.start for r in rows) == list(range(0, 24000, 8))


def test_rebase(spark):
    value = " ".join(["word"] * 600) + " a@b.io " + "x " * 300
    chunks = chunk_text(texts(spark, value), max_length=64)
    joined = rebase_spans(detect(chunks, RuleDetector()), chunks)
    direct = detect_in_document(chunks, RuleDetector())
    key = ["doc_id", "chunk_id", "start", "end", "label"]
    assert {tuple(r) for r in joined.select(key).collect()} == {tuple(r) for r in direct.select(key).collect()}
    assert all(value[r.start:r.end] == "a@b.io" for r in direct.collect())


def test_threshold_and_labels(spark):
    rows = spark.createDataFrame([(0.3, 0.5), (0.5, 0.5)], "score double, limit double")
    assert apply_threshold(rows, 0.3).count() == 2 and apply_threshold(rows, "limit").count() == 1
    preds = spark.createDataFrame(
        [("A", "B"), ("", "B"), (None, "C"), ("", None), (None, None)], "entity_group string, entity string"
    )
    assert [r.label for r in coalesce_label(preds).collect()] == ["A", "B", "C"]


GOLDEN = [
    ([(0, 5, "A", 0.6), (3, 8, "B", 0.9)], [(3, 8, "B", 0.9)]),
    ([(0, 5, "A", 0.9), (5, 8, "B", 0.2)], [(0, 5, "A", 0.9), (5, 8, "B", 0.2)]),
    ([(0, 5, "A", 0.7), (4, 9, "B", 0.9), (8, 12, "C", 0.8)], [(4, 9, "B", 0.9)]),
    ([(0, 5, "A", 0.9), (4, 9, "B", 0.7), (8, 12, "C", 0.8)], [(0, 5, "A", 0.9)]),
    ([(0, 5, "A", 0.5), (0, 5, "B", 0.5)], [(0, 5, "A", 0.5)]),
    ([(0, 4, "A", 0.5), (0, 6, "B", 0.5)], [(0, 4, "A", 0.5)]),
]


def span_rows(doc_id, spans):
    return [(doc_id, s, e, i, 0, label, score) for i, (s, e, label, score) in enumerate(spans)]


def resolved_both_ways(spark, rows, segment):
    df = spark.createDataFrame(rows, SPAN_ROW)
    cols = ["doc_id", "start", "end", "chunk_id", "pos", "label", "score"]
    table = {tuple(r) for r in resolve_overlaps(df, segment).select(cols).collect()}
    span = F.struct("start", "end", "chunk_id", "pos", "label", "score")
    arrays = df.groupBy("doc_id").agg(resolve_array(F.collect_list(span).cast(SPANS)).alias("r"))
    array = {tuple(r) for r in arrays.select("doc_id", F.inline("r")).select(cols).collect()}
    return table, array


def test_overlap_golden(spark):
    rows = [r for i, (spans, _) in enumerate(GOLDEN) for r in span_rows(i, spans)]
    want = {(i, *s) for i, (_, out) in enumerate(GOLDEN) for s in out}
    for got in resolved_both_ways(spark, rows, 4):
        assert {(r[0], r[1], r[2], r[5], r[6]) for r in got} == want


@pytest.mark.parametrize("segment", [1, 7, 50, 8192])
def test_overlap_random(spark, segment):
    rng = random.Random(segment)
    rows = []
    for doc in range(60):
        for chunk in range(rng.randint(1, 3)):
            for pos in range(rng.randint(0, 5)):
                start = rng.randint(0, 80)
                rows.append((doc, start, start + rng.randint(1, 12), chunk, pos, rng.choice("ABC"), rng.choice([0.3, 0.5, 0.9])))
    want = {
        (doc, *w)
        for doc in {r[0] for r in rows}
        for w in models.winners([r[1:] for r in rows if r[0] == doc])
    }
    for got in resolved_both_ways(spark, rows, segment):
        assert got == want


def test_overlap_hot_document(spark):
    """One document with most spans, copies included, still gives the sequential result."""
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        start = rng.randint(0, 30000)
        rows.append((7, start, start + rng.randint(1, 4), i % 4, i, rng.choice("AB"), rng.choice([0.4, 0.8])))
    rows += [(7, 100, 130, i, 0, "C", 0.4) for i in range(500)] + span_rows(8, GOLDEN[0][0])
    want = {(d, *w) for d in (7, 8) for w in models.winners([r[1:] for r in rows if r[0] == d])}
    for got in resolved_both_ways(spark, rows, 512):
        assert got == want


def test_redact_golden(spark):
    df = texts(spark, "My email is john@example.com", "nothing", "abcde")
    spans = spark.createDataFrame(
        [(0, 12, 28, "EMAIL"), (2, 0, 3, "A"), (2, 3, 5, "B")], "doc_id long, start int, end int, label string"
    )
    got = {r.doc_id: (r.redacted, r.entity_count) for r in redact(df, spans).collect()}
    assert got == {0: ("My email is [EMAIL]", 1), 1: ("nothing", 0), 2: ("[A][B]", 2)}


def test_redact_long_text(spark):
    """Texts beyond one block, with wide characters, equal the right-to-left edit."""
    rng = random.Random(11)
    value = "".join(rng.choice("ab é𝒳日\n") for _ in range(30000))
    cuts = sorted(rng.sample(range(len(value)), 800))
    spans = [(a, b, "X%d" % (i % 3)) for i, (a, b) in enumerate(zip(cuts[::2], cuts[1::2]))]
    want = list(value)
    for a, b, label in reversed(spans):
        want[a:b] = f"[{label}]"
    df = spark.createDataFrame([(value, spans)], "text string, s array<struct<start:int,end:int,label:string>>")
    assert df.select(redact_text(F.col("text"), F.col("s"))).first()[0] == "".join(want)


def test_redact_documents(spark):
    filler = "lorem ipsum dolor. " * 400
    value = filler + "mail a.b@c.example.org now " + filler + "or +1 (555) 555-0100"
    rows = redact_documents(texts(spark, value, "no spans here", "ip 1.2.3.4!"), max_length=64).orderBy("doc_id").collect()
    assert rows[0].redacted == filler + "mail [EMAIL] now " + filler + "or [TEL]"
    assert [(e.label, e.text, value[e.start:e.end]) for e in rows[0].entities] == [
        ("EMAIL", "a.b@c.example.org", "a.b@c.example.org"), ("TEL", "+1 (555) 555-0100", "+1 (555) 555-0100"),
    ]
    assert (rows[1].redacted, rows[1].entities, rows[1].entity_count) == ("no spans here", [], 0)
    assert rows[2].redacted == "ip [IP]!" and rows[2].text == "ip 1.2.3.4!"


def test_redaction_keeps_the_rest(spark):
    rng = random.Random(21)
    values = [random_text(rng, n) for n in (10, 200, 1200)]
    once = redact_documents(texts(spark, *values), max_length=40).select("doc_id", "text", "redacted", "entities").collect()
    for r in once:
        rebuilt, at = "", 0
        for e in r.entities:
            rebuilt, at = rebuilt + r.text[at:e.start] + f"[{e.label}]", e.end
        assert r.redacted == rebuilt + r.text[at:]


def test_redacting_twice_changes_nothing(spark):
    rng = random.Random(22)
    pieces = ["alpha", "é1", "a.b@c.io", "10.0.0.1", "+1 (555) 555-0100", "4994226020900891", "x."]
    value = " ".join(rng.choice(pieces) for _ in range(900))
    once = redact_documents(texts(spark, value), max_length=64).select("doc_id", F.col("redacted").alias("text"))
    row = redact_documents(once, max_length=64).first()
    assert row.redacted == row.text and row.entity_count == 0 and "[EMAIL]" in row.text


def test_per_row_threshold(spark):
    df = spark.createDataFrame([(0, "1.2.3.4 a@b.io", 0.97), (1, "1.2.3.4 a@b.io", 0.1)], "doc_id long, text string, t double")
    got = {r.doc_id: r.redacted for r in redact_documents(df, threshold="t").collect()}
    assert got == {0: "1.2.3.4 [EMAIL]", 1: "[IP] [EMAIL]"}
