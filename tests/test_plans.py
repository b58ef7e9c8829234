"""Physical plans: what is pushed down, shuffled and broadcast."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilframe.functions import layout
from veilframe.functions.layout import token_layout, token_layouts
from veilframe.functions.bounded import broadcast_if_small
from veilframe.operators.alignment import align, encode_labels
from veilframe.operators.detect import RuleDetector, detect_in_document
from veilframe.operators.alignment import encode_labels
from veilframe.operators.evaluate import decode_tags
from veilframe.operators.governance import daily_quota
from veilframe.operators.labels import split_half
from veilframe.operators.labels import build_vocab
from veilframe.operators.overlap import resolve_overlaps
from veilframe.operators.rows import filter_language, mask_rows
from veilframe.operators.tokens import chunk_text, tokenize
from veilframe.plans.redact import redact_documents
from veilframe.plans.silver import MASK
from veilframe.sources.corpus import read_corpus, write_corpus
from veilframe.sources.tables import spread

DOCS = "/root/testdata/sf0.001/documents.parquet"
CORPUS = f"doc_id long, source_text string, privacy_mask array<{MASK}>, language string, split string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCS).select("doc_id", "text")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "c")
    rows = [(i, f"mail {i} a@b.io", [(7, 13, "EMAIL")], "en", "train") for i in range(50)]
    spark.createDataFrame(rows, CORPUS).write.parquet(path)
    return spark.read.schema(CORPUS).parquet(path)


def test_redaction_is_one_pass_without_shuffle_or_python(docs):
    text = plan(redact_documents(docs))
    assert "Exchange" not in text and "Python" not in text and "Join" not in text
    assert text.count("FileScan") == 1 and "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_tokens_chunks_and_alignment_do_not_shuffle(docs, corpus):
    for df in (tokenize(docs), chunk_text(docs), align(corpus)):
        assert "Exchange" not in plan(df)


def test_token_lists_are_computed_once(docs):
    assert plan(tokenize(docs)).count("regexp_extract_all(") == 1
    assert plan(redact_documents(docs)).count("FileScan") == 1


def test_language_filter_reaches_the_scan(corpus):
    text = plan(filter_language(corpus, "en").select("doc_id"))
    assert "EqualTo(language,en)" in text
    assert "ReadSchema: struct<doc_id:bigint,language:string>" in text


def test_one_split_reads_one_partition(spark, corpus, tmp_path):
    write_corpus(corpus.drop("language"), str(tmp_path / "c"))
    text = plan(read_corpus(spark, str(tmp_path / "c"), "train").select("doc_id"))
    assert "PartitionFilters: [isnotnull(split" in text and "source_text" not in text.split("ReadSchema")[1]


def test_vocabulary_is_no_join(corpus):
    vocab = build_vocab(mask_rows(corpus, "doc_id"))
    text = plan(encode_labels(align(corpus), vocab))
    assert "Join" not in text.split("Subqueries")[0]


def test_large_lookups_are_not_hinted(spark):
    table = spark.range(20)
    assert "broadcast" in broadcast_if_small(table)._jdf.queryExecution().toString()
    assert "broadcast" not in broadcast_if_small(table, limit=19)._jdf.queryExecution().toString()


def test_overlap_reads_its_input_once(docs):
    spans = detect_in_document(chunk_text(docs), RuleDetector())
    text = final_plan(resolve_overlaps(spans))
    assert text.count("FileScan") == 1 and "ReusedExchange" in text


def operators(df):
    """Names of the physical operators, without those of subqueries."""
    open_, names = [df._jdf.queryExecution().sparkPlan()], set()
    while open_:
        node = open_.pop()
        names.add(node.nodeName())
        open_ += [node.children().apply(i) for i in range(node.children().size())]
    return names


def test_tokens_and_texts_stay_where_they_are(spark):
    vocab = spark.createDataFrame([(0, "O"), (1, "B-A")], "label_id int, label string")
    tokens = spark.range(9).selectExpr("id doc_id", "0 token_idx", "0 word_id", "0 start", "0 word_start", "'O' tag", "0 gold_id", "1 pred_id")
    docs = spark.range(9).selectExpr("id doc_id", "'a' source_text")
    for df in (encode_labels(tokens, vocab), decode_tags(tokens, vocab), split_half(docs)):
        assert operators(df) <= {"Project", "Filter", "Range", "Scan ExistingRDD", "LocalTableScan"}, operators(df)
        assert df.count() == 9


def test_quota_is_cut_before_its_shuffle(spark):
    df = spark.range(100).select(
        (F.col("id") % 3).alias("client"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("request_id")
    )
    text = plan(daily_quota(df))
    assert "WindowGroupLimit" in text.split("Exchange")[-1] or text.count("WindowGroupLimit") >= 2


def test_spread_leaves_big_tables_alone(spark):
    assert "RoundRobin" in plan(spread(spark.read.parquet(DOCS)))
    assert "RoundRobin" not in plan(spread(spark.range(10**10).selectExpr("id", "id a", "id b")))


@pytest.mark.parametrize("window", [(0, 5), (1, 4), (2, 3), (3, 3)])
def test_layout_of_a_sliced_batch(window):
    lists = [["a", " b", "."], [], ["é", "𝒳", "  c"], ["\n日"], []]
    batch = pa.array(lists, pa.list_(pa.string())).slice(window[0], window[1] - window[0])
    got = token_layout.func(batch).to_pylist()
    want = [
        {"start": [0, 1, 3], "end": [1, 3, 4], "word_id": [0, 1, 1], "word_start": [0, 1, 1], "word_end": [1, 4, 4]},
        {"start": [], "end": [], "word_id": [], "word_start": [], "word_end": []},
        {"start": [0, 1, 2], "end": [1, 2, 5], "word_id": [0, 0, 1], "word_start": [0, 0, 2], "word_end": [2, 2, 5]},
        {"start": [0], "end": [2], "word_id": [0], "word_start": [0], "word_end": [2]},
        {"start": [], "end": [], "word_id": [], "word_start": [], "word_end": []},
    ]
    assert got == want[slice(*window)]


@pytest.mark.parametrize("part", [1, 3, 100])
def test_a_batch_is_laid_out_in_parts(monkeypatch, part):
    monkeypatch.setattr(layout, "PART", part)
    lists = [["a", " b"], [], ["c"], ["d", ".", " e", "f", " g"], None, [" h"], []]
    batches = [pa.array(lists, pa.list_(pa.string())).slice(a, n) for a, n in ((0, 7), (1, 4), (2, 0))]
    got = list(token_layouts.func(iter(batches)))
    assert [x for g in got for x in g.to_pylist()] == [x for b in batches for x in token_layout.func(b).to_pylist()]
    assert part == 100 or max(len(g) for g in got) < 7
    assert all(len(g) <= 1 or len(g.field("end").flatten()) <= part for g in got)


def test_missing_texts(spark):
    df = spark.createDataFrame([(0, None), (1, "a@b.io")], "doc_id long, text string")
    rows = redact_documents(df).orderBy("doc_id").collect()
    assert (rows[0].redacted, rows[0].entity_count, rows[1].redacted) == (None, 0, "[EMAIL]")
    assert [r.doc_id for r in tokenize(df).select("doc_id").distinct().collect()] == [1]


def test_rules_compile_no_pattern_for_a_text(spark):
    """``split`` compiles its pattern for every text, except for a single character."""
    found = spark.range(1).select(RuleDetector().spans(F.concat(F.lit("a@b.org +1.2.3.4 x 7"), F.col("id").cast("string"))).alias("s"))
    said = found._jdf.queryExecution().optimizedPlan().toString()
    assert said.count("split(") == said.count(", \x03, -1)") > 0
    assert [(x.start, x.end, x.label) for x in found.first().s] == [(0, 7, "EMAIL"), (9, 16, "IP")]
