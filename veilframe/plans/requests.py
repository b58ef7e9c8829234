"""The life of redaction requests as one batch: validate, admit, redact, log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.detect import Detector
from ..operators.governance import client_ip, daily_quota, request_log, validate_requests
from .redact import redact_documents

# Outcome of a request.
DONE, INVALID, OVER_QUOTA = 200, 422, 429


def serve_requests(
    requests: DataFrame, detector: Detector | None = None, limit: int | None = 10
) -> DataFrame:
    """Add ``status_code``, ``reason`` and, for admitted requests, the redaction.

    Only valid requests count against a client's day. Refused rows carry no text
    into the detector, so all outcomes come from one pass without a union.
    Needs ``request_id, ts, text, threshold, forwarded, host``.
    """
    client = client_ip(F.col("forwarded"), F.col("host"))
    checked = validate_requests(requests).withColumn("client", client)
    admitted = (
        checked.withColumn("accepted", F.lit(True))
        if limit is None
        else daily_quota(checked, limit, counted=F.col("is_valid")).drop("day")
    )
    status = F.when(~F.col("is_valid"), INVALID).when(~F.col("accepted"), OVER_QUOTA).otherwise(DONE)
    coded = admitted.withColumn("status_code", status)

    def granted(value: Column) -> Column:
        return F.when(F.col("status_code") == DONE, value)

    done = redact_documents(coded.withColumn("text", granted(F.col("text"))), detector, "threshold")
    return done.withColumns(
        {"entities": granted(F.col("entities")), "entity_count": granted(F.col("entity_count"))}
    ).drop("client", "is_valid", "accepted")


def served_log(served: DataFrame) -> DataFrame:
    """The privacy-safe log of served requests; lengths and counts only where admitted."""
    return request_log(served)
