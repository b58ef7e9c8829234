"""Order-preserving packing: window cuts by dynamic programming over a token stream.

Documents in id order form a stream; a window holds at most ``window`` tokens of
it. Cuts lie at document or sentence ends (and, inside stretches without any, at
regular places). Among all ways to cut, the one with least padding plus penalties
is taken: for a full window that is a sliding minimum kept in a monotone queue,
for a window whose length is a power of two, which needs no padding, a lookup per
power. A stream is a run of whole documents of about ``stream`` tokens, so streams
are independent and nothing global is sorted or numbered.

Defined results: null and empty text is the end id alone; repeated rows are packed
as often as they occur; no rows give no pieces; a text longer than a window is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, shuffle_width, tidy
from .tokens import MEMORY, encoder, sentence_ends, size_batches

WINDOW, STREAM = 2048, 1 << 20
# Costs in padding tokens: any window, a cut at a sentence end, a cut elsewhere.
WINDOW_COST, SENTENCE_COST, HARD_COST = 4, 4, 64
HARD_STEP = 256
ENCODED = 400_000  # characters encoded at a time
END = 1
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cut_places(ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, ascending, and what a cut there costs."""
    n = len(ids)
    cost = np.full(n + 1, -1, np.int8)
    cost[np.flatnonzero(ends[ids]) + 1] = SENTENCE_COST
    cost[np.concatenate([[0], np.cumsum(sizes)])] = 0
    soft = np.flatnonzero(cost >= 0)
    gaps = np.diff(soft)
    for at in np.flatnonzero(gaps > HARD_STEP):
        cost[np.arange(soft[at] + HARD_STEP, soft[at + 1], HARD_STEP)] = HARD_COST
    places = np.flatnonzero(cost >= 0)
    return places, cost[places].astype(np.int64)


def best_cuts(places: np.ndarray, costs: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indices into ``places`` at which the cheapest packing cuts, first and last included."""
    n = len(places)
    exact: dict[int, list[int]] = {}
    power = 1
    while power <= window:
        near = np.searchsorted(places, places - power)
        hits = np.flatnonzero((places >= power) & (places[near] == places - power))
        for j, i in zip(hits.tolist(), near[hits].tolist(), strict=True):
            exact.setdefault(j, []).append(i)
        power *= 2
    at, price = places.tolist(), (costs + WINDOW_COST).tolist()
    best, came = [0] * n, [0] * n
    # The queue: starts with rising levels, a level being what a padded window from there costs
    # before its end is taken off. What falls behind the window is passed by ``head``.
    starts, levels, head = [0], [window + at[0]], 0
    for j in range(1, n):
        here = at[j]
        oldest = here - window
        while at[starts[head]] < oldest:
            head += 1
        i, least = starts[head], levels[head] - here
        if j in exact:
            for k in exact[j]:
                if best[k] < least:
                    least, i = best[k], k
        best[j] = least = least + price[j]
        came[j] = i
        level = least + here + window
        while levels and levels[-1] >= level and len(levels) > head:
            levels.pop()
            starts.pop()
        starts.append(j)
        levels.append(level)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return cuts[::-1]


def _pieces(keys: list, ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray, window: int, first: int) -> tuple[pd.DataFrame, int]:
    """Pieces of one stream, and how many sequences it made."""
    places, costs = cut_places(ids, sizes, ends)
    cuts = places[best_cuts(places, costs, window)]
    docs = np.concatenate([[0], np.cumsum(sizes)])
    edges = np.union1d(cuts, docs)
    start, length = edges[:-1], np.diff(edges)
    doc = np.searchsorted(docs, start, side="right") - 1
    sequence = np.searchsorted(cuts, start, side="right") - 1
    raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
    out = pd.DataFrame(
        {
            "doc_id": pd.array([keys[d] for d in doc.tolist()], dtype="Int64"),
            "start": start - docs[doc],
            "length": length,
            "ids": [bytes(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)],
            "doc_tokens": sizes[doc],
            "sequence_id": first + sequence,
            "offset": start - cuts[sequence],
        }
    )
    return out, len(cuts) - 1


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, stream: int = STREAM, memory: int = MEMORY) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``vocabulary`` is the path of a byte-level tokenizer file that every executor has;
    a worker remembers the ids of ``memory`` pieces of text.
    Sequence numbers are unique: partition and number within it.
    """
    if window < HARD_STEP:
        raise ValueError(f"a window holds at least {HARD_STEP} tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, ends = encoder(vocabulary, True, END, memory), sentence_ends(vocabulary)
        number = TaskContext.get().partitionId() << 32
        keys, ids, sizes, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, keys, ids, sizes, held
            flat, ids = np.concatenate(ids), []
            out, made = _pieces(keys, flat, np.concatenate(sizes), ends, window, number)
            number += made
            keys, sizes, held = [], [], 0
            return pa.RecordBatch.from_pandas(out, preserve_index=False)

        for batch in batches:  # its texts become Python strings a range at a time
            names, texts = batch.column("doc_id"), batch.column("text")
            for a, b in size_batches(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
                some = texts.slice(a, b - a)
                for c, d in size_batches(pc.fill_null(pc.utf8_length(some), 0).to_pylist(), ENCODED):
                    flat, counts = tool.encode(some.slice(c, d - c).to_pylist())
                    ids.append(flat)
                    sizes.append(counts)
                    held += len(flat)
                keys += names.slice(a, b - a).to_pylist()
                if held >= stream:
                    yield flush()
                    give_back()
            batch = names = texts = some = None  # before the next one comes
        if held:
            yield flush()

    return in_order(docs, key, text).mapInArrow(tidy(run), PIECES)


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text`` in ranges of ascending id; equal ids may share out by their text's hash."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", "tie"]
    ranged = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(shuffle_width(docs.sparkSession), *order)
    return ranged.sortWithinPartitions(*order).select("doc_id", "text")
