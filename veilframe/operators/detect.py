"""Detectors: chunks of text in, scored spans out."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_structs, let
from ..functions.rules import DEFAULT_RULES, Numbers, Rule, may_match, text_spans
from .tokens import first_tokens


class Detector(Protocol):
    """``spans`` maps a text column to an array of spans relative to that text.

    ``chunk_spans`` does so for an array of chunks (structs with ``text``), one array of
    spans per chunk. ``may_match`` may rule out a text early; it must be true for every
    text with a part that holds a span.
    """

    def spans(self, text: Column) -> Column: ...

    def chunk_spans(self, chunks: Column) -> Column: ...

    def may_match(self, text: Column) -> Column: ...


class RuleDetector:
    """Applies a catalogue of rules; pass your own to replace or extend the default."""

    def __init__(self, catalogue: Sequence[Rule | Numbers] = tuple(DEFAULT_RULES)) -> None:
        self.catalogue = list(catalogue)

    def spans(self, text: Column) -> Column:
        return text_spans(text, self.catalogue)

    def chunk_spans(self, chunks: Column) -> Column:
        return F.transform(chunks, lambda c: self.spans(c["text"]))

    def may_match(self, text: Column) -> Column:
        return may_match(text, self.catalogue)


def detect(chunks: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """Rows ``doc_id, chunk_id, start, end, label, score, pos`` relative to each chunk."""
    found = F.transform(
        detector.spans(F.col(text)),
        lambda s: F.struct(s["start"], s["end"], s["label"], s["score"], s["pos"]),
    )
    return explode_structs(chunks, ["doc_id", "chunk_id"], found)


def detect_in_document(chunks: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """The same in document offsets, straight from rows that carry the chunk's ``start``."""
    found = F.transform(
        detector.spans(F.col(text)),
        lambda s: F.struct(
            (s["start"] + F.col("start")).alias("start"),
            (s["end"] + F.col("start")).alias("end"),
            s["label"],
            s["score"],
            s["pos"],
        ),
    )
    return explode_structs(chunks, ["doc_id", "chunk_id"], found)


def rebase_spans(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk-relative offsets to document offsets, for spans stored apart from the chunks.

    The key is ``(doc_id, chunk_id)``, so a long document spreads over many tasks.
    """
    base = chunks.select("doc_id", "chunk_id", F.col("start").alias("chunk_start"))
    moved = spans.join(base, ["doc_id", "chunk_id"])
    return moved.withColumns(
        {"start": F.col("start") + F.col("chunk_start"), "end": F.col("end") + F.col("chunk_start")}
    ).drop("chunk_start")


def apply_threshold(spans: DataFrame, threshold: float | str = 0.3) -> DataFrame:
    """Keep scores at or above a number, or above a per-row column of that name."""
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    return spans.where(F.col("score") >= limit)


def coalesce_label(preds: DataFrame) -> DataFrame:
    """Prefer ``entity_group`` over ``entity``; an empty group counts as missing.

    Rows with neither are dropped.
    """
    label = F.coalesce(F.nullif(F.col("entity_group"), F.lit("")), F.col("entity"))
    return preds.withColumn("label", label).where(F.col("label").isNotNull()).drop(
        "entity_group", "entity"
    )


def word_groups(words: Column) -> Column:
    """Join adjacent words of one entity into spans; the score is the mean over words.

    ``words`` holds structs ``start, end, tag, score`` in order. A group starts at
    a word whose tag is ``B-`` or whose entity differs from the word before.
    """

    def entity(w: Column) -> Column:
        return F.regexp_replace(w["tag"], "^[BI]-", "")

    def build(ws: Column) -> Column:
        opens = F.filter(
            F.sequence(F.lit(0), F.size(ws) - 1),
            lambda i: (i == 0)
            | F.startswith(F.get(ws, i)["tag"], F.lit("B-"))
            | (entity(F.get(ws, i)) != entity(F.get(ws, F.greatest(i - 1, F.lit(0))))),
        )
        return let(opens, lambda os: F.transform(os, lambda s, k: group(ws, s, F.coalesce(F.get(os, k + 1), F.size(ws)))))

    def group(ws: Column, first: Column, stop: Column) -> Column:
        members = F.slice(ws, first + 1, stop - first)
        total = F.aggregate(members, F.lit(0.0), lambda acc, w: acc + w["score"])
        return F.struct(
            F.get(ws, first)["start"].alias("start"),
            F.get(ws, stop - 1)["end"].alias("end"),
            entity(F.get(ws, first)).alias("label"),
            (total / (stop - first)).alias("score"),
        )

    empty = F.array().cast("array<struct<start:int,end:int,label:string,score:double>>")
    grouped = let(words, lambda ws: F.when(F.size(ws) > 0, build(ws)).otherwise(empty))
    return F.filter(grouped, lambda g: g["label"] != "O")


def aggregate_first(token_preds: DataFrame) -> DataFrame:
    """Token predictions to spans: a word takes the class and score of its first token.

    Input rows hold ``doc_id`` and ``tokens``, an array of structs ``word_id,
    word_start, word_end, tag, score`` in order, as a tagger returns them.
    """
    words = F.transform(
        first_tokens(F.col("tokens")),
        lambda t: F.struct(
            t["word_start"].alias("start"), t["word_end"].alias("end"), t["tag"], t["score"]
        ),
    )
    return explode_structs(token_preds, ["doc_id"], word_groups(words))
