"""Offsets and words of a list of token strings, one vectorised pass per batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ["start", "end", "word_id", "word_start", "word_end"]
LAYOUT = T.StructType([T.StructField(name, T.ArrayType(T.IntegerType())) for name in FIELDS])
BLANKS = [" ", "\t", "\n", "\f", "\r"]
PART = 1 << 17  # tokens laid out at a time


@F.arrow_udf(LAYOUT)
def token_layout(tokens: pa.Array) -> pa.Array:
    """Per token its span, the number of its word and that word's span.

    Tokens tile the text, so a span is a running length; a word begins at the
    first token or at one with leading whitespace. No built-in gives a running
    sum inside an array in linear time, and a window over exploded tokens would
    shuffle all of them.
    """
    offsets = tokens.offsets.to_numpy()
    bounds = offsets - offsets[0]
    texts = tokens.values.slice(offsets[0], bounds[-1])
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    blank = pc.is_in(pc.utf8_slice_codeunits(texts, 0, 1), value_set=pa.array(BLANKS, texts.type))
    opens = np.append(blank.to_numpy(zero_copy_only=False), False)
    opens[bounds[:-1]] = True
    opens = opens[:-1]

    per_row = np.diff(bounds)
    total = np.concatenate([[0], np.cumsum(lengths)])
    end = total[1:] - np.repeat(total[bounds[:-1]], per_row)
    start = end - lengths
    words = np.concatenate([[0], np.cumsum(opens)])
    word = words[1:] - 1
    word_id = word - np.repeat(words[bounds[:-1]], per_row)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(lengths)) - 1 if len(first) else first
    columns = [start, end, word_id, start[first][word], end[last][word]]
    lists = [
        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(c, pa.int32())) for c in columns
    ]
    return pa.StructArray.from_arrays(lists, FIELDS)


@F.arrow_udf(LAYOUT)
def token_layouts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``token_layout`` in parts of a batch, so that a task holds its input and one part.

    A batch has up to 10,000 texts, and laid out whole takes some 200 bytes a token; a
    part is as many rows as hold ``PART`` tokens, or one row that holds more.
    """
    for tokens in batches:
        bounds, row = tokens.offsets.to_numpy(), 0
        if not len(tokens):
            yield token_layout.func(tokens)
        while row < len(tokens):
            stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + PART, "right")) - 1)
            yield token_layout.func(tokens.slice(row, stop - row))
            row = stop
