"""Overlap resolution and redaction on tables of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import redact_text
from .carry import running_max

SEGMENT_CHARS = 8192


def resolve_overlaps(spans: DataFrame, segment: int = SEGMENT_CHARS) -> DataFrame:
    """Keep one span, the best, of every transitively overlapping group of a document.

    Columns ``doc_id, start, end, label, score, chunk_id, pos``; spans are not
    empty. Ties go to the first by ``start, end, chunk_id, pos``. Equal intervals
    always share a group, so they are reduced before any ordering; the winner of
    a group is an aggregate, not a window, and combines on the map side.
    """
    best = F.max(F.struct("score", (-F.col("chunk_id")).alias("c"), (-F.col("pos")).alias("p"), "label"))
    distinct = spans.groupBy("doc_id", "start", "end").agg(best.alias("b"))
    reach = running_max(
        distinct, ["doc_id"], "start", ["start", "end"], F.col("end"), "reach", segment, inclusive=False
    )
    opens = F.col("reach").isNull() | (F.col("start") >= F.col("reach"))
    grouped = running_max(
        reach, ["doc_id"], "start", ["start", "end"], F.when(opens, F.col("start")), "group_start",
        segment, inclusive=True,
    )
    winner = F.max(
        F.struct(
            F.col("b.score"),
            (-F.col("start")).alias("s"),
            (-F.col("end")).alias("e"),
            F.col("b.c"),
            F.col("b.p"),
            F.col("b.label"),
        )
    )
    return grouped.groupBy("doc_id", "group_start").agg(winner.alias("w")).select(
        "doc_id",
        (-F.col("w.s")).alias("start"),
        (-F.col("w.e")).alias("end"),
        F.col("w.label").alias("label"),
        F.col("w.score").alias("score"),
        (-F.col("w.c")).alias("chunk_id"),
        (-F.col("w.p")).alias("pos"),
    )


def redact(df: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """Replace disjoint spans by ``[LABEL]``; texts without spans pass unchanged.

    The spans of one document are gathered into its row, as its text already is.
    """
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "label")))
    per_doc = spans.groupBy("doc_id").agg(ordered.alias("_spans"))
    empty = F.array().cast("array<struct<start:int,end:int,label:string>>")
    joined = df.join(per_doc, "doc_id", "left").withColumn("_spans", F.coalesce("_spans", empty))
    return joined.withColumns(
        {
            "redacted": redact_text(F.col(text), F.col("_spans")),
            "entity_count": F.size("_spans"),
        }
    ).drop("_spans")
