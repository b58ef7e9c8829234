"""Request validation, client identity, privacy-safe logs and daily quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CHARS = 10_000
DEFAULT_THRESHOLD = 0.3

# The characters that count as blank in a request.
BLANK = (
    r"\t\n\x{0b}\f\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# The only request fields a log line may carry.
LOG_FIELDS = [
    "request_id", "client_id", "endpoint", "method", "status_code", "duration_ms",
    "text_length", "entity_count",
]


def validate_requests(df: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Add ``threshold`` (defaulted), ``is_valid`` and ``reason``; texts stay as sent."""
    text = F.col("text")
    limit = F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD))
    reason = (
        F.when(text.isNull(), "missing")
        .when(F.length(text) == 0, "empty")
        .when(F.length(text) > max_chars, "too_long")
        .when(~text.rlike(f"[^{BLANK}]"), "blank")
        .when(~limit.between(0.0, 1.0) | F.isnan(limit), "threshold")
    )
    checked = df.withColumn("threshold", limit).withColumn("reason", reason)
    return checked.withColumn("is_valid", F.col("reason").isNull())


def client_id(key: Column, ip: Column) -> Column:
    """Masked key, else hashed address, else ``anonymous``."""
    masked = F.concat(F.substring(key, 1, 4), F.lit("..."), F.right(key, F.lit(4)))
    hashed = F.concat(F.lit("ip_"), F.substring(F.sha2(ip, 256), 1, 8))
    has_key = F.coalesce(key, F.lit("")) != ""
    has_ip = F.coalesce(ip, F.lit("")) != ""
    return F.when(has_key, masked).when(has_ip, hashed).otherwise("anonymous")


def client_ip(forwarded: Column, host: Column) -> Column:
    """First forwarded address, else the peer, else ``unknown``."""
    first = F.regexp_replace(F.split(forwarded, ",")[0], f"^[{BLANK}]+|[{BLANK}]+$", "")
    return F.when(F.coalesce(forwarded, F.lit("")) != "", first).otherwise(
        F.coalesce(host, F.lit("unknown"))
    )


def request_log(requests: DataFrame, logger: str = "veilframe.requests") -> DataFrame:
    """One log row per request: the allowed fields and nothing of the text itself.

    Needs ``request_id, api_key, host, endpoint, method, status_code, duration,
    ts, text, entities``; ``duration`` is in seconds. A request without a status has
    failed: it is logged as an error with who asked for what, and nothing measured.
    """
    done = F.col("status_code").isNotNull()
    fresh = F.coalesce("request_id", F.uuid())
    values = {
        "request_id": fresh,
        "client_id": client_id(F.col("api_key"), F.col("host")),
        "duration_ms": F.when(done, F.round(F.col("duration") * 1000, 2)),
        "text_length": F.when(done, F.length("text")),
        "entity_count": F.when(done & F.col("entities").isNotNull(), F.size("entities")),
    }
    fields = [values.get(f, F.col(f)).alias(f) for f in LOG_FIELDS]
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return requests.select(
        stamp.alias("timestamp"),
        F.when(done, "INFO").otherwise("ERROR").alias("level"),
        F.lit(logger).alias("logger"),
        F.when(done, "request_completed").otherwise("request_failed").alias("message"),
        *fields,
    )


def daily_quota(
    requests: DataFrame, limit: int = 10, client: str = "client", counted: Column | None = None
) -> DataFrame:
    """Add ``accepted``: whether a request is among its client's first ``limit`` that UTC day.

    Requests are ordered by time, id and a fingerprint of the row. Rows that are equal in
    all columns are one place in that order which weighs as often as it occurs. Where the
    limit falls inside a place, just so many of its rows are accepted as are left. Rows for
    which ``counted`` does not hold neither count nor are accepted.

    The exchange that is keyed by client carries no text and at most ``limit`` places
    per client, day and task; what was accepted then meets the rows by place, so a busy
    client is no busy key. Only the rows of a place that the limit cuts, at most one for a
    client and day, are numbered.
    """
    names = [f"_{n}" for n in ("day", "place", "counts")]
    day, place, counts = (n if n not in requests.columns else f"_{n}" for n in names)
    holds = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    marked = requests.withColumns({place: F.xxhash64(*requests.columns), "day": F.to_date("ts"), counts: holds})
    keys = [client, "day", "ts", "request_id", place]
    weighed = marked.where(counts).groupBy(*keys).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(client, "day").orderBy("ts", "request_id", place)
    firsts = weighed.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit)
    free = limit - (F.sum("_n").over(order) - F.col("_n"))
    within = firsts.withColumn("_free", free).where(F.col("_free") > 0)
    taken = within.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_free", (F.col("_n") > F.col("_free")).alias("_cut"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = marked.join(taken, same & F.col(counts), "left")
    cut = F.coalesce(F.col("_cut"), F.lit(False))
    equal = Window.partitionBy(*keys).orderBy(F.lit(0))
    numbered = out.where(cut).withColumn("accepted", F.row_number().over(equal) <= F.col("_free"))
    others = out.where(~cut).withColumn("accepted", F.col("_free").isNotNull())
    return others.unionByName(numbered).select(*requests.columns, "day", "accepted")
