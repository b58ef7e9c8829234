"""Corpus preparation from raw rows to a cleaned, split and described corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.labels import build_vocab, label_counts, split_half
from ..operators.rows import assert_absent, drop_labels, filter_language, mask_rows, rare_labels


@dataclass(frozen=True)
class Prepared:
    corpus: DataFrame
    vocab: DataFrame
    counts: DataFrame
    rare: DataFrame

    def check(self) -> None:
        """Fail if a removed label is still present."""
        assert_absent(mask_rows(self.corpus, "split"), self.rare)


def prepare_corpus(
    raw: DataFrame, language: str = "English", min_count: int = 50, seed: int = 42
) -> Prepared:
    """Filter, drop rare labels, build the vocabulary and halve validation."""
    rows = filter_language(raw, language)
    train_masks = mask_rows(rows.where(F.col("split") == "train"), "doc_id")
    rare = rare_labels(train_masks, min_count)
    cleaned = drop_labels(rows, rare).select("doc_id", "source_text", "privacy_mask", "split")
    vocab = build_vocab(mask_rows(cleaned.where(F.col("split") == "train"), "doc_id"))
    train = cleaned.where(F.col("split") == "train")
    halves = split_half(cleaned.where(F.col("split") == "validation"), seed=seed)
    final = train.unionByName(halves.withColumn("split", F.col("half")).drop("half"))
    return Prepared(final, vocab, label_counts(mask_rows(final, "split")), rare)
