"""A labelled corpus and predictions derived from the documents table.

The tables hold no gold spans, so the rule detectors supply silver ones, and
predictions are silver spans disturbed by a hash: some dropped, some relabelled,
some widened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..operators.detect import RuleDetector
from ..sources.tables import documents

MASK = "struct<start:int,end:int,label:string>"


def split_of(doc_id: Column) -> Column:
    """About a fifth of the documents go to validation."""
    first = F.substring(F.md5(doc_id.cast("string")), 1, 1)
    return F.when(first < "3", F.lit("validation")).otherwise(F.lit("train"))


def corpus(spark: SparkSession, sf_dir: str, first: int | None = None) -> DataFrame:
    """``doc_id, source_text, privacy_mask, language, split``; masks may overlap.

    With ``first``, of that many documents by id only, for reports that show no more.
    """
    docs = documents(spark, sf_dir)
    if first is not None:
        docs = docs.orderBy("doc_id").limit(first)
    found = F.array_sort(RuleDetector().spans(F.col("text")))
    masks = F.transform(found, lambda s: F.struct(s["start"], s["end"], s["label"]))
    return docs.select(
        "doc_id",
        F.col("text").alias("source_text"),
        masks.cast(f"array<{MASK}>").alias("privacy_mask"),
        F.col("lang").alias("language"),
        split_of(F.col("doc_id")).alias("split"),
    )


def disturbed(doc_id: Column, masks: Column) -> Column:
    """Predicted masks: by the first hex digit of a hash, 0-2 drops, 3-4 relabels, 5-6 widens."""

    def digit(m: Column) -> Column:
        key = F.concat_ws(":", doc_id.cast("string"), m["start"].cast("string"), m["label"])
        return F.substring(F.md5(key), 1, 1)

    kept = F.filter(masks, lambda m: digit(m) > "2")
    return F.transform(
        kept,
        lambda m: F.struct(
            m["start"].alias("start"),
            (m["end"] + F.when(digit(m).isin("5", "6"), 8).otherwise(0)).alias("end"),
            F.when(digit(m).isin("3", "4"), F.lit("TEL")).otherwise(m["label"]).alias("label"),
        ),
    )


def scored_corpus(spark: SparkSession, sf_dir: str, first: int | None = None) -> DataFrame:
    """The corpus with predicted masks next to the silver ones."""
    rows = corpus(spark, sf_dir, first)
    predicted = let(F.col("privacy_mask"), lambda ms: disturbed(F.col("doc_id"), ms))
    return rows.withColumn("predicted_mask", predicted)
