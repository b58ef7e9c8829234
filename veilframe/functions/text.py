"""Tokens, split points, chunks and replacements as column expressions.

All offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# Whitespace and the token form. Both are spelled out so that
# Java and RE2 read them alike.
WS = r" \t\n\f\r"
TOKEN = rf"[{WS}]*(?:[\p{{L}}\p{{N}}_]+|[^{WS}\p{{L}}\p{{N}}_])"

# Where a chunk may end, by priority of kind.
SEPARATORS = ["\n\n", "\n", ". ", "? ", "! "]
LOOKBACK = 80
SPECIAL_TOKENS = 2

TEXT_BLOCK = 4096


def token_strings(text: Column) -> Column:
    """Tokens as strings; each carries its leading whitespace."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def split_after(tail: Column, end: Column) -> Column:
    """Natural split position given the text just before ``end``."""
    back = let(F.reverse(tail), lambda rev: _first_found(rev, end))
    return F.coalesce(back, end)


def _first_found(rev: Column, end: Column) -> Column:
    found = [F.instr(rev, sep[::-1]) for sep in SEPARATORS]
    return F.coalesce(*[F.when(at > 0, end + 1 - at) for at in found])


def logical_split(text: Column, end: Column, lookback: int = LOOKBACK) -> Column:
    """Position after the last separator in the ``lookback`` chars before ``end``."""
    begin = F.greatest(F.lit(0), end - lookback)
    return split_after(F.substring(text, begin + 1, end - begin), end)


CHUNK = "struct<chunk_id:int,start:int,end:int,first_token:int,end_token:int>"


def span_length(tokens: Column, first: Column, stop: Column) -> Column:
    """Characters in tokens ``first`` to ``stop``, without the offsets of all tokens."""
    return F.length(F.array_join(F.slice(tokens, first + 1, stop - first), ""))


def chunk_array(text: Column, tokens: Column, max_length: int = 512, stride: float = 0.5) -> Column:
    """Overlapping chunks as an array of structs; see ``CHUNK`` for the fields.

    Every next start depends on where the previous chunk snapped, so this is a
    fold. One step reads the tokens of one chunk, so the whole is linear in the
    text. ``tokens`` may be empty for a text known to be a single chunk.
    """
    if not 0 < stride < 1:
        raise ValueError("stride must lie in (0, 1)")
    budget = max_length - SPECIAL_TOKENS
    overlap = int(max_length * stride)
    progress = max(1, budget - LOOKBACK - 1 - overlap)

    def edge(stop: Column, end: Column) -> Column:
        return F.struct(stop.alias("stop"), end.alias("end"))

    def snapped(first: Column, begin: Column, at: Column) -> Column:
        """Leave out the tokens that start after the split point before ``at``."""
        near = F.greatest(F.lit(0), at["stop"] - LOOKBACK)
        tail = F.substring(
            F.array_join(F.slice(tokens, near + 1, at["stop"] - near), ""), -LOOKBACK, LOOKBACK
        )
        behind = F.greatest(first, at["stop"] - LOOKBACK - 1)
        backwards = F.reverse(F.slice(tokens, behind + 1, at["stop"] - behind))

        def walk(limit: Column) -> Column:
            def back(acc: Column, token: Column) -> Column:
                start = acc["end"] - F.length(token)
                return F.when(acc["done"] | (start <= limit), F.struct(acc["stop"], acc["end"], F.lit(True).alias("done"))).otherwise(
                    F.struct((acc["stop"] - 1).alias("stop"), start.alias("end"), F.lit(False).alias("done"))
                )

            zero = F.struct(at["stop"].alias("stop"), at["end"].alias("end"), F.lit(False).alias("done"))
            kept = F.aggregate(backwards, zero, back, lambda acc: edge(acc["stop"], acc["end"]))
            return F.when(begin > limit, at).otherwise(kept)

        return let(split_after(tail, at["end"]), walk)

    def step(acc: Column, n: Column) -> Column:
        first, begin = acc["first"], acc["begin"]
        tentative = let(
            F.least(first + budget, n), lambda stop: edge(stop, begin + span_length(tokens, first, stop))
        )
        final = let(
            tentative,
            lambda at: F.when(at["stop"] < n, snapped(first, begin, at)).otherwise(
                edge(n, F.length(text))
            ),
        )

        def moved(at: Column) -> Column:
            following = F.when(at["stop"] >= n, n).otherwise(
                F.greatest(at["stop"] - overlap, first + 1)
            )
            chunk = F.struct(
                F.size(acc["out"]).alias("chunk_id"),
                begin.alias("start"),
                at["end"].alias("end"),
                first.alias("first_token"),
                at["stop"].alias("end_token"),
            )
            return let(
                following,
                lambda f: F.struct(
                    f.alias("first"),
                    (at["end"] - span_length(tokens, f, at["stop"])).alias("begin"),
                    F.concat(acc["out"], F.array(chunk)).alias("out"),
                ),
            )

        return F.when(first >= n, acc).otherwise(let(final, moved))

    def fold(n: Column) -> Column:
        steps = F.sequence(F.lit(0), F.ceil(n / F.lit(progress)).cast("int"))
        zero = F.struct(
            F.lit(0).alias("first"), F.lit(0).alias("begin"), F.array().cast(f"array<{CHUNK}>").alias("out")
        )
        return F.aggregate(steps, zero, lambda acc, _: step(acc, n), lambda acc: acc["out"])

    whole = F.array(
        F.struct(
            F.lit(0).alias("chunk_id"),
            F.lit(0).alias("start"),
            F.length(text).alias("end"),
            F.lit(0).alias("first_token"),
            F.size(tokens).alias("end_token"),
        )
    )
    return F.when(F.size(tokens) <= max_length, whole.cast(f"array<{CHUNK}>")).otherwise(
        let(F.size(tokens), fold)
    )


def chunk_string(text: Column, tokens: Column, n_chunks: Column, chunk: Column) -> Column:
    """Text of one chunk, joined from its tokens: no scan from the text's start."""
    joined = F.array_join(
        F.slice(tokens, chunk["first_token"] + 1, chunk["end_token"] - chunk["first_token"]), ""
    )
    tail = F.regexp_extract(text, rf"[{WS}]*\z", 0)
    last = F.when(chunk["end_token"] >= F.size(tokens), F.concat(joined, tail)).otherwise(joined)
    return F.when(n_chunks == 1, text).otherwise(last)


def text_blocks(text: Column) -> Column:
    """The text cut into blocks of equal length, for cheap random access."""
    short = F.length(text) <= TEXT_BLOCK
    return F.when(short, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    )


def piece(text_block_list: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` from the blocks: cost follows the piece, not the text."""
    first = F.floor(start / F.lit(TEXT_BLOCK)).cast("int")
    last = F.floor(end / F.lit(TEXT_BLOCK)).cast("int")
    joined = F.array_join(F.slice(text_block_list, first + 1, last - first + 1), "")
    return F.substring(joined, start - first * TEXT_BLOCK + 1, end - start)


def redact_text(text: Column, spans: Column) -> Column:
    """Replace sorted disjoint spans by ``[LABEL]``, reading the text left to right."""

    def pieces(parts: Column, ordered: Column) -> Column:
        between = F.transform(
            ordered,
            lambda s, i: F.concat(
                piece(parts, F.coalesce(F.get(ordered, i - 1)["end"], F.lit(0)), s["start"]),
                F.lit("["),
                s["label"],
                F.lit("]"),
            ),
        )
        rest = piece(parts, F.element_at(ordered, -1)["end"], F.length(text))
        return F.concat(F.array_join(between, ""), rest)

    return F.when(F.size(spans) == 0, text).otherwise(
        let(spans, lambda ss: let(text_blocks(text), lambda bs: pieces(bs, ss)))
    )
