"""Gold and predicted tags side by side, one row per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_structs
from ..operators.alignment import tags_of
from ..operators.tokens import with_tokens


def tagged_pairs(corpus: DataFrame, predicted: str = "predicted_mask") -> DataFrame:
    """``doc_id, tokens``: structs ``token, gold, pred``.

    Tokens are cut once and both sides are projected onto them in the same row.
    """
    tagged = with_tokens(corpus, "source_text").select(
        "doc_id",
        F.col("tokens").alias("token"),
        tags_of("privacy_mask").alias("gold"),
        tags_of(predicted).alias("pred"),
    )
    return tagged.select("doc_id", F.arrays_zip("token", "gold", "pred").alias("tokens"))


def kept_sequences(pairs: DataFrame) -> DataFrame:
    """Only the tokens that count: later tokens of a labelled word are ignored."""
    kept = F.filter(
        "tokens", lambda t: (t["gold"] == "O") | (t["token"]["start"] == t["token"]["word_start"])
    )
    return pairs.select("doc_id", kept.alias("tokens"))


def tag_columns(sequences: DataFrame) -> DataFrame:
    """``doc_id, gold, pred`` as arrays of tags."""
    return sequences.select(
        "doc_id",
        F.col("tokens.gold").alias("gold"),
        F.col("tokens.pred").alias("pred"),
    )


def token_rows(sequences: DataFrame) -> DataFrame:
    """Rows ``doc_id, token_idx, text, gold, pred``."""
    rows = explode_structs(sequences, ["doc_id"], F.col("tokens"))
    return rows.select("doc_id", "token.token_idx", "token.text", "gold", "pred")
