"""Request validation, logs, quotas and result documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.governance import client_id, client_ip, daily_quota, request_log, validate_requests
from ..plans.redact import redact_documents
from ..plans.requests import serve_requests, served_log
from ..session import shared_dir
from ..sources.tables import documents, spread, table
from ..sources.texts import read_redactions, read_texts, redaction_json, write_redactions
from ..streaming.quota import batch_counts, stream_accept, stream_quota
from ..streaming.redaction import stream_redact
from . import REGISTRY, sql
from .text import _E3, entity_line

add = REGISTRY.add

_REQUESTS = """
req AS (
  SELECT 'd' || d.doc_id AS request_id, d.text, CASE WHEN l.toxic = 1 THEN 1.5 ELSE l.quality * 0.5 END AS threshold
  FROM documents d LEFT JOIN labels l USING (doc_id)
  UNION ALL
  SELECT 'c' || conv_id || '-' || turn, regexp_replace(text, '[\\p{L}.,?!;:]', '', 'g'), NULL FROM conversations)"""


def requests(spark, sf):
    """Documents with a threshold from their labels, and what is left of chat turns without letters."""
    labels = table(spark, sf, "labels")
    limit = F.when(F.col("toxic") == 1, 1.5).otherwise(F.col("quality") * 0.5)
    docs = table(spark, sf, "documents").join(labels, "doc_id", "left")
    turns = table(spark, sf, "conversations")
    return docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("request_id"), "text", limit.alias("threshold")
    ).unionByName(
        turns.select(
            F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("request_id"),
            F.regexp_replace("text", r"[\p{L}.,?!;:]", "").alias("text"),
            F.lit(None).cast("double").alias("threshold"),
        )
    )


@add(
    "b7_validate_requests",
    sql.with_(
        _REQUESTS,
        body=r"""SELECT request_id, CAST(coalesce(threshold, 0.3) AS DOUBLE) AS threshold, reason IS NULL AS is_valid, reason
                 FROM (SELECT *, CASE WHEN text IS NULL THEN 'missing' WHEN length(text) = 0 THEN 'empty'
                         WHEN length(text) > 10000 THEN 'too_long'
                         WHEN NOT regexp_matches(text, '[^ \t\n\f\r]') THEN 'blank'
                         WHEN coalesce(threshold, 0.3) NOT BETWEEN 0 AND 1 THEN 'threshold' END AS reason FROM req)""",
    ),
)
def b7(spark, sf):
    return validate_requests(requests(spark, sf)).drop("text")


# Where the shared folder is a local one, each file of Hadoop's own checksums is one more, and
# the access rights of both are set twice, by a process each; a plain file needs one.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


@add("a2_read_texts")
def a2(spark, sf):
    """Every document written as a file of its own and read back whole, a hundred to a folder.

    A folder holds rows of one task, so the driver moves folders, not files, when the
    write is committed. The file's number keeps rows of one id apart.
    """
    path = shared_dir(spark)
    number = F.monotonically_increasing_id()
    docs = documents(spark, sf).select("text", F.floor(number / 100).alias("folder"), "doc_id", number.alias("number"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("_"), F.col("number").cast("string"))
    files = docs.select("text", "folder", name.alias("doc"))
    files.write.options(**PLAIN_FILES).partitionBy("folder", "doc").option("lineSep", "\x00").text(path)
    back = read_texts(spark, path=path)
    return back.select(
        F.nullif(F.regexp_extract("path", "doc=(-?[0-9]*)_", 1), F.lit("")).cast("long").alias("source_id"),
        F.length(F.rtrim("text", F.lit("\x00"))).alias("n_chars"),
    )


REGISTRY.oracles["a2_read_texts"] = (
    "SELECT doc_id AS source_id, CAST(length(text) AS INT) AS n_chars FROM documents"
)


@add("a5_write_redactions", _E3)
def a5(spark, sf):
    path = shared_dir(spark)
    write_redactions(redact_documents(documents(spark, sf)), path)
    back = read_redactions(spark, path)
    return back.select("doc_id", "redacted", "entity_count", entity_line(F.col("entities")).alias("entities"))


@add(
    "a5_redaction_json",
    sql.with_(
        *sql.RESOLVED_MEMBERS, sql.REDACTED,
        body="""SELECT r.doc_id, CAST(to_json({'original': d.text, 'redacted': r.redacted, 'entities': coalesce(e.es, []),
                  'entity_count': r.entity_count}) AS VARCHAR) AS value
                FROM redacted r JOIN docs d USING (doc_id) LEFT JOIN (
                  SELECT s.doc_id, list({'text': substring(d.text, s."start" + 1, s."end" - s."start"), 'label': s.label,
                    'start': s."start", 'end': s."end", 'score': s.score} ORDER BY s."start") AS es
                  FROM resolved s JOIN docs d USING (doc_id) GROUP BY 1) e USING (doc_id)""",
        recursive=True,
    ),
)
def a5_json(spark, sf):
    return redaction_json(redact_documents(documents(spark, sf)))


_KEY = "CASE WHEN event_type = 'click' THEN 'key_' || user_id || '_' || event_id WHEN event_type = 'view' THEN '' END"
_IP = "CASE WHEN event_type <> 'error' THEN '10.0.' || user_id || '.1' END"
_FWD = "CASE WHEN event_type = 'view' THEN ' 192.168.' || user_id || '.7 , 10.1.1.1' WHEN event_type = 'click' THEN '' END"


def clients(spark, sf):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    return table(spark, sf, "events").withColumns(
        {
            "api_key": F.when(
                kind == "click", F.concat(F.lit("key_"), user, F.lit("_"), F.col("event_id").cast("string"))
            ).when(kind == "view", ""),
            "host": F.when(kind != "error", F.concat(F.lit("10.0."), user, F.lit(".1"))),
            "forwarded": F.when(
                kind == "view", F.concat(F.lit(" 192.168."), user, F.lit(".7 , 10.1.1.1"))
            ).when(kind == "click", ""),
        }
    )


_CLIENT_ID = """CASE WHEN coalesce(api_key, '') <> '' THEN left(api_key, 4) || '...' || right(api_key, 4)
  WHEN coalesce(host, '') <> '' THEN 'ip_' || left(sha256(host), 8) ELSE 'anonymous' END"""
_CLIENT_IP = "CASE WHEN coalesce(forwarded, '') <> '' THEN trim(split_part(forwarded, ',', 1)) ELSE coalesce(host, 'unknown') END"
_CLIENTS = f"cl AS (SELECT *, {_KEY} AS api_key, {_IP} AS host, {_FWD} AS forwarded FROM events)"


@add("i1_client_id", sql.with_(_CLIENTS, body=f"SELECT event_id, {_CLIENT_ID} AS client_id FROM cl"))
def i1(spark, sf):
    return clients(spark, sf).select("event_id", client_id(F.col("api_key"), F.col("host")).alias("client_id"))


@add("i2_client_ip", sql.with_(_CLIENTS, body=f"SELECT event_id, {_CLIENT_IP} AS client_ip FROM cl"))
def i2(spark, sf):
    return clients(spark, sf).select("event_id", client_ip(F.col("forwarded"), F.col("host")).alias("client_ip"))


@add(
    "i3_request_log",
    sql.with_(
        _CLIENTS,
        body=f"""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS "timestamp", 'INFO' AS level,
                 'veilframe.requests' AS logger, 'request_completed' AS message, 'r' || event_id AS request_id, {_CLIENT_ID} AS client_id,
                 '/' || event_type AS endpoint, 'POST' AS method,
                 CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS INT) AS status_code,
                 round(value * 1000, 2) AS duration_ms, CAST(length(props) AS INT) AS text_length, 0 AS entity_count
                 FROM cl""",
    ),
)
def i3(spark, sf):
    return request_log(logged(spark, sf, F.when(F.col("event_type") == "error", 500).otherwise(200)))


@add(
    "i3_failed_requests",
    sql.with_(
        _CLIENTS,
        body=f"""SELECT CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'veilframe.requests' AS logger,
                 CASE WHEN event_type = 'error' THEN 'request_failed' ELSE 'request_completed' END AS message,
                 'r' || event_id AS request_id, {_CLIENT_ID} AS client_id, '/' || event_type AS endpoint, 'POST' AS method,
                 CAST(CASE WHEN event_type <> 'error' THEN 200 END AS INT) AS status_code,
                 CASE WHEN event_type <> 'error' THEN round(value * 1000, 2) END AS duration_ms,
                 CAST(CASE WHEN event_type <> 'error' THEN length(props) END AS INT) AS text_length,
                 CASE WHEN event_type <> 'error' THEN 0 END AS entity_count FROM cl""",
    ),
)
def i3_failed(spark, sf):
    """A request that ended in an exception has no status, and its log row nothing measured."""
    return request_log(logged(spark, sf, F.when(F.col("event_type") != "error", 200))).drop("timestamp")


def logged(spark, sf, status):
    return clients(spark, sf).select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"),
        "api_key",
        "host",
        F.concat(F.lit("/"), "event_type").alias("endpoint"),
        F.lit("POST").alias("method"),
        status.alias("status_code"),
        F.col("value").alias("duration"),
        "ts",
        F.col("props").alias("text"),
        F.array().alias("entities"),
    )


@add(
    "i4_daily_quota",
    """SELECT event_id AS request_id, CAST(ts AS DATE) AS day,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 5 AS accepted FROM events""",
)
def i4(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("client"), "ts", F.col("event_id").alias("request_id")
    )
    return daily_quota(rows, limit=5).select("request_id", "day", "accepted")


@add(
    "i4_quota_of_ties",
    """WITH req AS (
         SELECT user_id % 5 AS client, date_trunc('hour', ts) AS ts,
                CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'same' ELSE 'r' || (event_id % 7) END AS request_id FROM events),
       run AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY client, CAST(ts AS DATE) ORDER BY ts, request_id NULLS FIRST) AS rn FROM req)
       SELECT client, day, request_id, rn <= 9 AS accepted, count(*) AS n FROM run GROUP BY ALL""",
)
def i4_ties(spark, sf):
    """Requests whose id and time repeat, or that have no id: of equal rows as many as are left."""
    event = F.col("event_id")
    rows = table(spark, sf, "events").select(
        (F.col("user_id") % 5).alias("client"),
        F.date_trunc("hour", "ts").alias("ts"),
        F.when(event % 3 == 1, "same").when(event % 3 == 2, F.concat(F.lit("r"), (event % 7).cast("string"))).alias("request_id"),
    )
    return daily_quota(rows, limit=9).groupBy("client", "day", "request_id", "accepted").agg(F.count("*").alias("n"))


@add(
    "j2_quota_counts",
    """SELECT user_id AS client, CAST(ts AS DATE) AS day, count(*) AS n, count(*) > 5 AS over_quota
       FROM events GROUP BY ALL""",
)
def j2(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("client"), "ts")
    return batch_counts(rows, limit=5)


@add(
    "j2_stream_quota",
    """SELECT user_id AS client, CAST(ts AS DATE) AS day, count(*) AS n, count(*) > 5 AS over_quota
       FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 1 HOUR AS DATE) FROM events) GROUP BY ALL""",
)
def j2_stream(spark, sf):
    """The stream's closed days: a day closes when the watermark passes its end."""
    base = shared_dir(spark)
    stream = given(spark, sf, "events")
    rows = stream.select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    counted = stream_quota(rows, limit=5, delay="1 hour")
    query = (
        counted.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{base}/out")


@add(
    "j2_stream_accept",
    """SELECT event_id AS request_id, CAST(ts AS DATE) AS day,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 5 AS accepted FROM events""",
)
def j2_accept(spark, sf):
    """Every request of the stream with its answer, which is that of the batch."""
    base = shared_dir(spark)
    rows = given(spark, sf, "events").select(
        F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("request_id")
    )
    answered = stream_accept(rows, limit=5, delay="366 days")  # the table is not in order of time
    query = (
        answered.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(answered.schema).parquet(f"{base}/out").select("request_id", "day", "accepted")


def given(spark, sf, name):
    """A given table as a stream: a pattern, as a table may be one file or a folder of them."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/{name}.parque[t]")


@add("j1_stream_redact", _E3)
def j1(spark, sf):
    base = shared_dir(spark)
    stream = given(spark, sf, "documents").select("doc_id", "text")
    query = stream_redact(stream, f"{base}/out", f"{base}/bad", f"{base}/state", max_chars=None)
    query.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select("doc_id", "redacted", "entity_count", entity_line(F.col("entities")).alias("entities"))


_SERVED = """
rq AS (SELECT doc_id, 'd' || doc_id AS request_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * doc_id AS ts, text, source AS host,
         CASE WHEN length(text) > 10000 THEN 'too_long' END AS reason, n_chars / 100000 AS duration FROM documents),
adm AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 422
           WHEN row_number() OVER (PARTITION BY host, CAST(ts AS DATE), reason IS NULL ORDER BY ts, request_id) > 10 THEN 429
           ELSE 200 END AS status_code FROM rq)"""


def served(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    rows = docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("request_id"),
        F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, cast(doc_id as int), 0)").alias("ts"),
        "text",
        F.lit(None).cast("double").alias("threshold"),
        F.lit(None).cast("string").alias("forwarded"),
        F.lit(None).cast("string").alias("api_key"),
        F.col("source").alias("host"),
        F.lit("/demo/redact").alias("endpoint"),
        F.lit("POST").alias("method"),
        (F.col("n_chars") / 100_000).alias("duration"),
    )
    return serve_requests(rows)


@add(
    "serve_requests",
    sql.with_(
        *sql.RESOLVED_MEMBERS, sql.REDACTED, _SERVED,
        body="""SELECT a.request_id, CAST(a.status_code AS INT) AS status_code, a.reason,
                  CASE WHEN a.status_code = 200 THEN r.redacted END AS redacted,
                  CASE WHEN a.status_code = 200 THEN r.entity_count END AS entity_count
                FROM adm a JOIN redacted r USING (doc_id)""",
        recursive=True,
    ),
)
def serve(spark, sf):
    return served(spark, sf).select("request_id", "status_code", "reason", "redacted", "entity_count")


@add(
    "serve_requests_log",
    sql.with_(
        *sql.RESOLVED_MEMBERS, sql.REDACTED, _SERVED,
        body="""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS "timestamp", 'INFO' AS level, 'veilframe.requests' AS logger, 'request_completed' AS message,
                  request_id, 'ip_' || left(sha256(host), 8) AS client_id, '/demo/redact' AS endpoint, 'POST' AS method,
                  CAST(status_code AS INT) AS status_code, round(duration * 1000, 2) AS duration_ms,
                  CASE WHEN status_code = 200 THEN CAST(length(a.text) AS INT) END AS text_length,
                  CASE WHEN status_code = 200 THEN r.entity_count END AS entity_count
                FROM adm a JOIN redacted r USING (doc_id)""",
        recursive=True,
    ),
)
def serve_log(spark, sf):
    return served_log(served(spark, sf))
