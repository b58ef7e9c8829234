"""Tokens, words, chunks: one pass over the text, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_structs, let
from ..functions.layout import FIELDS, token_layouts
from ..functions.text import SPECIAL_TOKENS, chunk_array, chunk_string, token_strings


def with_layout(df: DataFrame, text: str = "text", max_length: int | None = None) -> DataFrame:
    """Add ``_tok`` (token strings) and ``_lay`` (parallel arrays of offsets and words)."""
    kept = token_strings(F.col(text))
    if max_length is not None:
        kept = F.slice(kept, 1, max_length - SPECIAL_TOKENS)
    return df.withColumn("_tok", kept).withColumn("_lay", token_layouts("_tok"))


def zipped(*fields: str) -> Column:
    """Layout arrays zipped into structs with their position and text."""
    n = F.size("_tok")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    parts = [F.col("_lay")[f].alias(f) for f in fields]
    return F.arrays_zip(index.alias("token_idx"), *parts, F.col("_tok").alias("text"))


def with_tokens(df: DataFrame, text: str = "text", max_length: int | None = None) -> DataFrame:
    """Add ``tokens``: structs ``token_idx, start, end, word_id, word_start, word_end, text``.

    ``max_length`` cuts before words are built and counts the special tokens a
    model adds, so a word at the cut spans its kept tokens only.
    """
    out = with_layout(df, text, max_length)
    return out.withColumn("tokens", zipped(*FIELDS)).drop("_tok", "_lay")


def tokenize(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows ``doc_id, token_idx, start, end, text``; the tokens join back to the text."""
    return explode_structs(with_layout(df, text), ["doc_id"], zipped("start", "end"))


def word_tokens(df: DataFrame, text: str = "text", max_length: int | None = None) -> DataFrame:
    """Tokens with the word they belong to and that word's span."""
    return explode_structs(with_layout(df, text, max_length), ["doc_id"], zipped(*FIELDS))


def first_tokens(tokens: Column) -> Column:
    """The first token of every word."""
    return let(
        tokens,
        lambda ts: F.filter(
            ts,
            lambda t, i: F.coalesce(t["word_id"] != F.get(ts, i - 1)["word_id"], F.lit(True)),
        ),
    )


def word_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per word: the union of its tokens' spans."""
    words = F.transform(
        first_tokens(F.col("tokens")),
        lambda t: F.struct(
            t["word_id"].alias("word_id"), t["word_start"].alias("start"), t["word_end"].alias("end")
        ),
    )
    return explode_structs(with_tokens(df, text), ["doc_id"], words)


def word_spans_of(tokens: DataFrame) -> DataFrame:
    """The same from a stored token table with ``doc_id, word_id, start, end``."""
    real = tokens.where(F.col("word_id").isNotNull())
    return real.groupBy("doc_id", "word_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def truncate_tokens(tokens: DataFrame, max_length: int = 512) -> DataFrame:
    """Keep the tokens that fit a model's input next to its special tokens."""
    return tokens.where(F.col("token_idx") < max_length - SPECIAL_TOKENS)


def chunks_of(
    text: Column, max_length: int, stride: float, only: Column | None, body: Callable[[Column, Column], Column]
) -> Column:
    """``body(chunks, tokens)`` for one text.

    A text no longer than ``max_length`` characters cannot hold more tokens than
    that, so it is one chunk without tokenising. So is a text for which ``only``
    is false: a caller that needs no chunks of it says so there.
    """
    long = F.length(text) > max_length
    wanted = long if only is None else long & only
    strings = F.when(wanted, token_strings(text)).otherwise(F.array().cast("array<string>"))
    return let(
        strings,
        lambda ts: let(chunk_array(text, ts, max_length, stride), lambda cs: body(cs, ts)),
    )


def with_chunks(
    df: DataFrame,
    text: str = "text",
    max_length: int = 512,
    stride: float = 0.5,
    only: Column | None = None,
) -> DataFrame:
    """Add ``chunks``: structs ``chunk_id, start, end, text``; see ``chunks_of`` for ``only``."""

    def with_text(cs: Column, ts: Column) -> Column:
        return F.transform(
            cs,
            lambda c: F.struct(
                c["chunk_id"].alias("chunk_id"),
                c["start"].alias("start"),
                c["end"].alias("end"),
                chunk_string(F.col(text), ts, F.size(cs), c).alias("text"),
            ),
        )

    return df.withColumn("chunks", chunks_of(F.col(text), max_length, stride, only, with_text))


def chunk_text(
    df: DataFrame, text: str = "text", max_length: int = 512, stride: float = 0.5
) -> DataFrame:
    """Rows ``doc_id, chunk_id, start, end, text``."""
    return explode_structs(with_chunks(df, text, max_length, stride), ["doc_id"], F.col("chunks"))


def chunk_spans(
    df: DataFrame, text: str = "text", max_length: int = 512, stride: float = 0.5
) -> DataFrame:
    """Rows ``doc_id, chunk_id, start, end``: overlapping windows that cover the text."""

    def spans(cs: Column, _: Column) -> Column:
        return F.transform(cs, lambda c: F.struct(c["chunk_id"], c["start"], c["end"]))

    return explode_structs(df, ["doc_id"], chunks_of(F.col(text), max_length, stride, None, spans))
