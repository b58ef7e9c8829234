"""BIO tags as column expressions over arrays of tokens and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import blocks, let

IGNORED = -100

# How masks are projected onto tokens.
WORD_UNION = "word_union"
WORD_UNION_STICKY = "word_union_sticky"
CONTAIN = "contain"
OVERLAP = "overlap"
MODES = (WORD_UNION, WORD_UNION_STICKY, CONTAIN, OVERLAP)

HIT_BLOCK = 32
HIT_STRETCH = 2048


def entity(tag: Column) -> Column:
    return F.regexp_replace(tag, "^[BI]-", "")


def labelled_tokens(tokens: Column, masks: Column, mode: str) -> Column:
    """Tokens decided by a mask, as structs ``i, word_id, start, mask_start, label``.

    Tokens are taken in stretches and these in blocks; each looks only at the masks
    that reach into it, so a long text with many masks does not compare all with
    all, and parts without masks cost next to nothing.
    """
    by_word = mode in (WORD_UNION, WORD_UNION_STICKY)
    begin, stop = ("word_start", "word_end") if by_word else ("start", "end")

    def touches(token: Column, mask: Column) -> Column:
        if mode == CONTAIN:
            return (token[begin] >= mask["start"]) & (token[stop] <= mask["end"])
        return (token[begin] < mask["end"]) & (token[stop] > mask["start"])

    def near(block: Column, candidates: Column) -> Column:
        first, last = F.get(block, F.lit(0)), F.element_at(block, -1)
        return F.filter(candidates, lambda m: (m["start"] < last[stop]) & (m["end"] > first[begin]))

    def decided(token: Column, candidates: Column) -> Column:
        hits = F.filter(candidates, lambda m: touches(token, m))
        # by word the last mask wins, by token the first
        hit = F.get(hits, F.size(hits) - 1) if by_word else F.get(hits, F.lit(0))
        return F.struct(
            token["token_idx"].alias("i"),
            token["word_id"].alias("word_id"),
            token["start"].alias("start"),
            hit["start"].alias("mask_start"),
            hit["label"].alias("label"),
        )

    def narrowed(part: Column, candidates: Column, body) -> Column:
        """``body(masks)`` with the masks that reach into a part, or nothing at once."""
        return let(
            near(part, candidates),
            lambda ms: F.when(F.size(ms) > 0, body(ms)).otherwise(F.array().cast(LABELLED)),
        )

    def of_block(block: Column, ms: Column) -> Column:
        return F.filter(F.transform(block, lambda t: decided(t, ms)), lambda x: x["label"].isNotNull())

    def of_stretch(part: Column, ms: Column) -> Column:
        return F.flatten(
            F.transform(blocks(part, HIT_BLOCK), lambda b: narrowed(b, ms, lambda near_: of_block(b, near_)))
        )

    return F.flatten(
        F.transform(
            blocks(tokens, HIT_STRETCH), lambda p: narrowed(p, masks, lambda ms: of_stretch(p, ms))
        )
    )


LABELLED = "array<struct<i:int,word_id:int,start:int,mask_start:int,label:string>>"


def bio_tags(tokens: Column, masks: Column, mode: str = WORD_UNION) -> Column:
    """BIO tag per token, parallel to ``tokens``.

    Tags are settled among the labelled tokens alone; the O stretches between
    them are filled in whole.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")

    def continues(x: Column, before: Column) -> Column:
        if mode == CONTAIN:
            return x["start"] != x["mask_start"]
        if mode == OVERLAP:
            return x["start"] > x["mask_start"]
        same = (x["word_id"] == before["word_id"]) | (x["label"] == before["label"])
        if mode == WORD_UNION:
            same = same & (before["i"] == x["i"] - 1)
        return F.coalesce(same, F.lit(False))

    def stretch(x: Column, before: Column) -> Column:
        mark = F.when(continues(x, before), F.lit("I-")).otherwise(F.lit("B-"))
        gap = x["i"] - F.coalesce(before["i"], F.lit(-1)) - 1
        return F.concat(F.array_repeat(F.lit("O"), gap), F.array(F.concat(mark, x["label"])))

    def dense(ls: Column) -> Column:
        marked = F.flatten(F.transform(ls, lambda x, k: stretch(x, F.get(ls, k - 1))))
        rest = F.size(tokens) - F.coalesce(F.element_at(ls, -1)["i"], F.lit(-1)) - 1
        return F.concat(marked, F.array_repeat(F.lit("O"), rest))

    plain = F.array_repeat(F.lit("O"), F.size(tokens))
    some = let(labelled_tokens(tokens, masks, mode), lambda ls: F.when(F.size(ls) > 0, dense(ls)).otherwise(plain))
    return F.when(F.size(masks) > 0, some).otherwise(plain)


def tag_spans(tags: Column) -> Column:
    """Lenient IOB: spans ``array<struct<label,first,last>>`` over token positions.

    A span opens at ``B-``, or at ``I-`` after ``O``, another type, or nothing.
    The k-th opening and the k-th closing belong together, so both are found
    locally and zipped.
    """

    def same_run(ts: Column, i: Column) -> Column:
        """Whether token i carries on the span of token i - 1."""
        return F.coalesce(
            F.startswith(F.get(ts, i), F.lit("I-"))
            & (F.get(ts, i - 1) != "O")
            & (entity(F.get(ts, i)) == entity(F.get(ts, i - 1))),
            F.lit(False),
        )

    def build(ts: Column) -> Column:
        marked = F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: F.get(ts, i) != "O")

        def zipped(ms: Column) -> Column:
            opens = F.filter(ms, lambda i: ~same_run(ts, i))
            closes = F.filter(ms, lambda i: ~same_run(ts, i + 1))
            return F.transform(
                F.arrays_zip(opens.alias("first"), closes.alias("last")),
                lambda z: F.struct(
                    entity(F.get(ts, z["first"])).alias("label"),
                    z["first"].alias("first"),
                    z["last"].alias("last"),
                ),
            )

        return let(marked, zipped)

    empty = F.array().cast("array<struct<label:string,first:int,last:int>>")
    return let(tags, lambda ts: F.when(F.size(ts) > 0, build(ts)).otherwise(empty))


def argmax(scores: Column) -> Column:
    """Index of the greatest element; the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
