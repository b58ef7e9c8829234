"""Masks onto tokens: tags, label ids, class weights and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import explode_structs, let
from ..functions.tags import IGNORED, WORD_UNION, bio_tags
from .tokens import with_tokens


def with_tags(
    corpus: DataFrame,
    mode: str = WORD_UNION,
    masks: str = "privacy_mask",
    alias: str = "tags",
) -> DataFrame:
    """Add an array of BIO tags next to an existing ``tokens`` array."""
    return corpus.withColumn(alias, tags_of(masks, mode))


def tags_of(masks: str, mode: str = WORD_UNION) -> Column:
    return let(F.col("tokens"), lambda ts: let(F.col(masks), lambda ms: bio_tags(ts, ms, mode)))


def align(
    corpus: DataFrame,
    mode: str = WORD_UNION,
    text: str = "source_text",
    max_length: int | None = None,
) -> DataFrame:
    """Rows ``doc_id, token_idx, word_id, start, end, word_start, word_end, text, tag``.

    Text and masks share a row, so this is a projection and an explode.
    """
    return tagged_rows(with_tags(with_tokens(corpus, text, max_length), mode))


def tagged_rows(tagged: DataFrame, tags: str = "tags") -> DataFrame:
    """The token rows of documents with parallel arrays ``tokens`` and tags."""
    rows = explode_structs(tagged, ["doc_id"], tagged_tokens("tokens", tags))
    return rows.select("doc_id", "token.*", "tag")


def tagged_tokens(tokens: str, tags: str) -> Column:
    """Structs ``token, tag``."""
    return F.arrays_zip(F.col(tokens).alias("token"), F.col(tags).alias("tag"))


def encode_labels(tokens: DataFrame, vocab: DataFrame, unknown: int | None = None) -> DataFrame:
    """Add ``label_id``: -100 for special tokens and later tokens of a labelled word.

    A later token of an unlabelled word keeps O. With ``unknown`` every later
    token is ignored and a tag outside the vocabulary gets that id instead.
    A token continues its word when it does not start where the word starts. Ids are
    looked up in the row, in a map from a scalar subquery: no token is moved.
    """
    names = fresh(tokens, "_ids")
    found = F.try_element_at(F.col(names), F.col("tag"))
    later = F.col("start") > F.col("word_start")
    if unknown is None:
        ignored = F.col("word_id").isNull() | (later & (F.col("tag") != "O"))
        value = found
    else:
        ignored = F.col("word_id").isNull() | later
        value = F.coalesce(found, F.lit(unknown))
    held = tokens.withColumn(names, id_map(vocab, "label", "label_id"))
    return held.withColumn("label_id", F.when(ignored, F.lit(IGNORED)).otherwise(value)).drop(names)


def fresh(df: DataFrame, stem: str) -> str:
    while stem in df.columns:
        stem = f"_{stem}"
    return stem


def id_map(vocab: DataFrame, key: str, value: str) -> Column:
    """The vocabulary as one map; ``O`` comes first, which most tokens look for."""
    pairs = F.array_sort(F.collect_list(F.struct("label_id", F.col(key).alias("k"), F.col(value).alias("v"))))
    entries = F.transform(pairs, lambda x: F.struct(x["k"], x["v"]))
    return vocab.agg(F.map_from_entries(entries)).scalar()


def class_weights(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """``label_id, label, n, weight``: inverse counts over all labels, summing to 1."""
    counts = (
        tokens.where(F.col("label_id") != IGNORED).groupBy("label_id").agg(F.count("*").alias("n"))
    )
    inverse = F.lit(1.0) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    weighted = vocab.select("label_id", "label").join(counts, "label_id", "left")
    return weighted.select(
        "label_id",
        "label",
        F.coalesce("n", F.lit(0)).alias("n"),
        (inverse / F.sum(inverse).over(Window.partitionBy())).alias("weight"),
    )


def stray_tokens(corpus: DataFrame, tokens: str = "tokens", tags: str = "tags") -> DataFrame:
    """Labelled tokens that touch no mask of their document.

    By word a token may be labelled through the rest of its word; those show here.
    """
    def touched(token: Column, masks: Column) -> Column:
        return F.exists(masks, lambda m: (token["end"] > m["start"]) & (token["start"] < m["end"]))

    stray = let(
        F.col("privacy_mask"),
        lambda ms: F.filter(
            tagged_tokens(tokens, tags), lambda t: (t["tag"] != "O") & ~touched(t["token"], ms)
        ),
    )
    rows = explode_structs(corpus, ["doc_id"], stray)
    return rows.select("doc_id", "token.token_idx", "token.start", "token.end", "tag")


def audit_alignment(corpus: DataFrame, tags: str = "tags") -> DataFrame:
    """Per document: masks, entity starts, tokens kept for training, and whether

    there are as many entity starts as masks.
    """
    begun = F.size(F.filter(tags, lambda t: F.startswith(t, F.lit("B-"))))
    kept = F.size(
        F.filter(
            tagged_tokens("tokens", tags),
            lambda t: (t["tag"] == "O") | (t["token"]["start"] == t["token"]["word_start"]),
        )
    )
    return corpus.select(
        "doc_id",
        F.size("privacy_mask").alias("n_masks"),
        begun.alias("n_entities"),
        kept.alias("n_valid"),
        (begun == F.size("privacy_mask")).alias("counts_match"),
    )
