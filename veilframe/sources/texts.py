"""Texts to redact and the results of redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(
    spark: SparkSession, texts: Sequence[str] | None = None, path: str | None = None
) -> DataFrame:
    """Rows ``doc_id, text`` from inline texts or from whole files, exactly one of both.

    ``doc_id`` is the position of an inline text, or a hash of the file's path.
    """
    if (texts is None) == (path is None):
        raise ValueError("give either texts or path")
    if texts is not None:
        if not texts or any(not t.strip() for t in texts):
            raise ValueError("text must not be empty")
        return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(
        F.xxhash64("_metadata.file_path").alias("doc_id"),
        F.col("value").alias("text"),
        F.col("_metadata.file_path").alias("path"),
    )


def redaction_json(df: DataFrame, text: str = "text", identity: Sequence[str] = ()) -> DataFrame:
    """``doc_id, value``: one JSON document per text; ``identity`` columns come first in it."""
    document = F.struct(
        *identity, F.col(text).alias("original"), F.col("redacted"), F.col("entities"), F.col("entity_count")
    )
    return df.select("doc_id", F.to_json(document).alias("value"))


def write_redactions(df: DataFrame, path: str, text: str = "text", mode: str = "error") -> None:
    """JSON lines that name the document, and its file where it came from one."""
    identity = [c for c in ("doc_id", "path") if c in df.columns]
    redaction_json(df, text, identity).select("value").write.mode(mode).text(path)


def read_redactions(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "doc_id long, path string, original string, redacted string, entities array<struct<text:string,label:string,"
        "start:int,end:int,score:double>>, entity_count int"
    )
    return spark.read.schema(schema).json(path)
