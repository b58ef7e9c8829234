"""A corpus pipeline over ``documents``: each stage's rows are written and read again.

Stages take ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents``. An empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import staged
from veilframe.llm.lines import drop_lines
from veilframe.llm.mixing import mixed_rows
from veilframe.llm.neardup import keep_first
from veilframe.llm.packing import pack
from veilframe.llm.queries import table, vocabulary
from veilframe.llm.toxicity import keep_clean, train

# Pieces of text that a worker remembers in packing: its memory still holds what earlier stages left.
PIECES = 120_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below their language's threshold.

    The classifier learns from the labelled documents of the corpus itself, not from
    what an earlier stage kept of them.
    """
    corpus = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return keep_clean(docs, train(corpus, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; those left without any go."""
    return drop_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8."""
    return keep_first(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a row per pass."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their ids."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), memory=PIECES)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# Hashes, a trained model and tokens: SQL cannot state them. Tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
