"""Continuous redaction: valid texts to one folder, rejected ones to another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import Detector
from ..operators.governance import MAX_CHARS, validate_requests
from ..plans.redact import DEFAULT_THRESHOLD, redact_documents

NO_LIMIT = 2**31 - 1


def redact_batch(batch: DataFrame, detector: Detector | None, max_chars: int | None) -> tuple[DataFrame, DataFrame]:
    """Redacted valid rows, and rejected rows with their reason."""
    if "threshold" not in batch.columns:
        batch = batch.withColumn("threshold", F.lit(DEFAULT_THRESHOLD))
    checked = validate_requests(batch, NO_LIMIT if max_chars is None else max_chars)
    valid = checked.where("is_valid").drop("is_valid", "reason")
    return redact_documents(valid, detector, "threshold"), checked.where("not is_valid").drop("is_valid")


def stream_redact(
    stream: DataFrame,
    out: str,
    rejected: str,
    checkpoint: str,
    detector: Detector | None = None,
    max_chars: int | None = MAX_CHARS,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the query. Each batch overwrites its own folder, so a replay changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # read once for both folders
        try:
            good, bad = redact_batch(held, detector, max_chars)
            good.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
            bad.write.mode("overwrite").parquet(f"{rejected}/batch_id={batch_id}")
        finally:
            held.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
