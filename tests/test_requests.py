import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilframe.operators.governance import LOG_FIELDS, client_id, client_ip, daily_quota, request_log, validate_requests
from veilframe.plans.redact import redact_documents
from veilframe.sources.texts import read_redactions, read_texts, redaction_json, write_redactions
from veilframe.queries import requests
from veilframe.queries.catalogue import REGISTRY
from veilframe.streaming.quota import batch_counts, stream_accept, stream_quota
from veilframe.streaming.redaction import stream_redact


@pytest.mark.parametrize(
    "text, threshold, reason",
    [
        ("x", None, None), ("", None, "empty"), ("   ", None, "blank"), (None, None, "missing"),
        ("y" * 10_001, None, "too_long"), ("y" * 10_000, 0.5, None), ("x", -0.1, "threshold"), ("x", 1.1, "threshold"),
        ("x", 0.0, None), ("x", 1.0, None), ("  \x1f　", None, "blank"), (" x ", None, None),
        ("x", float("nan"), "threshold"),
    ],
)
def test_validation(spark, text, threshold, reason):
    row = validate_requests(spark.createDataFrame([(text, threshold)], "text string, threshold double")).first()
    assert row.reason == reason and row.is_valid == (reason is None) and row.text == text
    if threshold is None:
        assert row.threshold == 0.3


def test_blank_agrees_with_python(spark):
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    rows = validate_requests(spark.createDataFrame([(c, None) for c in chars], "text string, threshold double"))
    blank = {r.text for r in rows.where("reason = 'blank'").collect()}
    assert blank == {c for c in chars if not c.strip()}


def test_clients(spark):
    rows = [("secret_token_123", "1.2.3.4"), (None, "1.2.3.4"), ("", "1.2.3.4"), (None, None), ("abc", None)]
    df = spark.createDataFrame(rows, "k string, ip string")
    assert [r[0] for r in df.select(client_id(F.col("k"), F.col("ip"))).collect()] == [
        "secr..._123", "ip_6694f83c", "ip_6694f83c", "anonymous", "abc...abc",
    ]
    rows = [(" 9.9.9.9 , 1.1.1.1", "2.2.2.2"), (None, "2.2.2.2"), ("", "2.2.2.2"), (None, None)]
    df = spark.createDataFrame(rows, "f string, h string")
    assert [r[0] for r in df.select(client_ip(F.col("f"), F.col("h"))).collect()] == ["9.9.9.9", "2.2.2.2", "2.2.2.2", "unknown"]


def test_log_holds_no_text(spark):
    df = spark.createDataFrame(
        [("r1", "key_12345678", "1.2.3.4", "/redact", "POST", 200, 0.0123456, datetime(2024, 1, 1), "my secret", ["secret"]),
         (None, None, None, "/redact", "POST", 200, 1.0, datetime(2024, 1, 1), "my secret", [])],
        "request_id string, api_key string, host string, endpoint string, method string, status_code int, "
        "duration double, ts timestamp, text string, entities array<string>",
    )
    log = request_log(df)
    assert set(log.columns) == {"timestamp", "level", "logger", "message", *LOG_FIELDS}
    one, two = log.orderBy(F.desc("entity_count")).collect()
    assert (one.client_id, one.duration_ms, one.text_length, one.entity_count) == ("key_...5678", 12.35, 9, 1)
    assert "secret" not in str(one) and len(two.request_id) == 36 and two.client_id == "anonymous"


def test_quota(spark):
    base = datetime(2024, 3, 1, 8)
    rows = [("a", base + timedelta(minutes=i), i) for i in range(11)]
    rows += [("a", base + timedelta(days=1), 50), ("b", base, 60), (None, base, 70)]
    out = daily_quota(spark.createDataFrame(rows, "client string, ts timestamp, request_id long")).collect()
    assert {r.request_id for r in out if not r.accepted} == {10} and len(out) == 14


def test_quota_hot_client(spark):
    """A client with nearly all requests, equal times included."""
    df = spark.range(20000).select(
        F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(-1).alias("client"),
        (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 5)).alias("ts"),
        F.col("id").alias("request_id"),
    )
    out = daily_quota(df, limit=7)
    hot = out.where("client = -1 and accepted").select("ts", "request_id").collect()
    assert len(hot) == 7 and out.count() == 20000
    first = sorted((r.ts, r.request_id) for r in df.where("client = -1").collect())[:7]
    assert sorted((r.ts, r.request_id) for r in hot) == first


def test_texts(spark, tmp_path):
    assert [tuple(r) for r in read_texts(spark, ["a", "b"]).collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "one.txt").write_text("line\nline two\n")
    (tmp_path / "two.txt").write_text("other")
    assert sorted(r.text for r in read_texts(spark, path=str(tmp_path)).collect()) == ["line\nline two\n", "other"]
    for bad in ({}, {"texts": ["a"], "path": "x"}, {"texts": []}, {"texts": ["  "]}):
        with pytest.raises(ValueError):
            read_texts(spark, **bad)


def test_result_documents(spark, tmp_path):
    out = redact_documents(read_texts(spark, ["mail a@b.io\nnow", "none"]))
    document = json.loads(redaction_json(out).where("doc_id = 0").first().value)
    assert document == {
        "original": "mail a@b.io\nnow", "redacted": "mail [EMAIL]\nnow", "entity_count": 1,
        "entities": [{"text": "a@b.io", "label": "EMAIL", "start": 5, "end": 11, "score": 0.99}],
    }
    write_redactions(out, str(tmp_path / "o"))
    back = {r.original: (r.redacted, r.entity_count) for r in read_redactions(spark, str(tmp_path / "o")).collect()}
    assert back == {"mail a@b.io\nnow": ("mail [EMAIL]\nnow", 1), "none": ("none", 0)}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"text {i} a{i}@b.io " + "pad " * (300 * (i % 3))) for i in range(30)] + [(90, "  "), (91, "z" * 10_001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_redact(stream, *[str(tmp_path / n) for n in ("out", "bad", "state")]).awaitTermination()
    got = {r.doc_id: r.redacted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.doc_id: r.redacted for r in redact_documents(df.where("doc_id < 90")).collect()}
    assert got == want
    assert {r.doc_id: r.reason for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {90: "blank", 91: "too_long"}


def test_redaction_runs_on_a_stream_without_batches(spark, tmp_path):
    df = spark.createDataFrame([(0, "a@b.io " + "w " * 700)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = redact_documents(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().redacted.startswith("[EMAIL] w")


def test_stream_quota_drops_late_events(spark, tmp_path):
    day = datetime(2024, 5, 1)
    batches = [
        [("a", day + timedelta(hours=h)) for h in range(1, 13)],
        [("a", day + timedelta(days=1, hours=3)), ("b", day + timedelta(hours=5))],
        [("a", day + timedelta(days=1, hours=4))],
        [("a", day + timedelta(hours=2)), ("a", day + timedelta(days=3))],
        [("c", day + timedelta(days=4))],
    ]
    source, schema = str(tmp_path / "in"), "client string, ts timestamp"
    rows = spark.readStream.schema(schema).parquet(source + "/*")
    counted = stream_quota(rows, limit=10, delay="1 hour")
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{source}/{i}")
        query = (
            counted.writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    got = {(r.client, r.day.day): (r.n, r.over_quota) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[("a", 1)] == (12, True) and got[("b", 1)] == (1, False)
    assert got[("a", 2)] == (2, False)
    batch = spark.createDataFrame([r for b in batches for r in b], schema)
    assert {(r.client, r.day.day): r.n for r in batch_counts(batch).collect()}[("a", 1)] == 13


def test_quota_accepts_equal_rows_up_to_the_limit(spark):
    day = datetime(2024, 1, 2, 10)
    rows = [("a", day, 1)] * 6 + [("a", day.replace(hour=11), 2)] + [("b", day, None)] * 2 + [(None, day, 1)] * 3
    out = daily_quota(spark.createDataFrame(rows, "client string, ts timestamp, request_id long"), limit=2)
    got = {(r.client, r.request_id): (r.n, r.yes) for r in out.groupBy("client", "request_id").agg(F.count("*").alias("n"), F.count_if("accepted").alias("yes")).collect()}
    assert got == {("a", 1): (6, 2), ("a", 2): (1, 0), ("b", None): (2, 2), (None, 1): (3, 2)}


def test_stream_answers_as_the_batch_does(spark, tmp_path):
    day = datetime(2024, 1, 2, 10)
    schema = "client string, ts timestamp, request_id long"
    batches = [
        [("a", day.replace(minute=i), i) for i in range(4)] + [("b", day, 9), (None, day, 1)],
        [("a", day.replace(hour=12, minute=i), 10 + i) for i in range(4)] + [("b", day.replace(hour=13), 8)],
        [("a", day.replace(day=3), 20), ("a", day.replace(day=3), 20), ("b", day.replace(hour=14), 7)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in[0-9]"))
    answered = stream_accept(stream, limit=5, delay="2 days")
    query = answered.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    every = spark.createDataFrame([r for rows in batches for r in rows], schema)
    key = ["client", "request_id", "day", "accepted"]
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(*key).collect()))
    assert got == sorted(map(str, daily_quota(every, limit=5).select(*key).collect())) and len(got) == 14


def test_a_file_for_every_row(spark, tmp_path):
    rows = [(7, "x" * n) for n in range(1, 41)] + [(None, "none"), (-3, "é"), (8, "")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    read = REGISTRY.queries["a2_read_texts"](spark, str(tmp_path)).collect()
    assert sorted((r.source_id or 0, r.n_chars) for r in read) == sorted((i or 0, len(t)) for i, t in rows)


def test_one_file_for_a_row_and_no_other(spark, tmp_path, monkeypatch):
    spark.range(3).selectExpr("id AS doc_id", "concat('t', id) AS text", "'en' AS lang").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(requests, "shared_dir", lambda _: f"{tmp_path}/files")
    assert sorted(map(tuple, REGISTRY.queries["a2_read_texts"](spark, str(tmp_path)).collect())) == [(0, 2), (1, 2), (2, 2)]
    assert len([p for p in (tmp_path / "files").rglob("*") if p.is_file() and "SUCCESS" not in p.name]) == 3


def test_stream_answers_a_busy_client_in_order_of_time(spark, tmp_path):
    rows = spark.range(12_000).selectExpr("'a' AS client", "timestamp_seconds(1704200000 - id) AS ts", "id AS request_id")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    answered = stream_accept(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), limit=3, delay="2 days")
    query = answered.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    read = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.request_id for r in read.where("accepted").collect()) == [11_997, 11_998, 11_999] and read.count() == 12_000
