"""Repeated byte strings: suffixes sorted digit by digit, only as deep as the threshold.

Every ``length``-byte string contains one anchor, the place in it whose 16-byte gram
has the least hash; strings that are equal have it at the same offset. So only the
suffixes at anchors are sorted, most significant digit first. The first digit is the
gram. The second is the whole stretch of neighbouring strings that share the anchor:
where it also stands in a smaller document, all of them are repeated, and nothing more
is asked. Only where a gram stands in several documents before different stretches are
the single strings compared, the last digit; groups that are equal then are exactly
the repeated strings. Digits travel as packed arrays, a few rows per task and digit.

Equality is that of 64-bit (strings) and 80-bit (stretches) hashes. Documents with a
null id match nothing; rows that share an id never match each other; null and empty
text has no bytes; text below ``length`` bytes keeps all; long texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import broadcast_if_small
from .common import REMEMBERED, enter, mix64, runs, shuffle_width, spans_of

GRAM = 16
HELD = 32_000_000  # bytes of text whose digits a task holds at a time
STRINGS = 2_000_000  # strings of the last digit that it holds at a time
PARTS = 4  # parts per shuffle partition
SHARE, SAMPLED = 500_000, 64  # a gram with more anchors is hot; they are counted on one document in 64
BASE = 0x9E3779B97F4A7C15
BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
U64 = 1 << 64
SIDES = 3  # ways a string can lie around its anchor, told apart by where it starts

DOCS = np.dtype([("id", "<i8"), ("mark", "<i8")])
SUFFIX = np.dtype(
    [("gram", "<u4"), ("run", "<u4"), ("run2", "<u2"), ("doc", "<u2"), ("at", "<u4"), ("far", "u1"), ("near", "u1"), *[(f"side{i}", "<u2") for i in range(SIDES)]]
)
STRING = np.dtype([("key", "<u8"), ("doc", "<u2"), ("at", "<u4")])
SPAN = np.dtype([("doc", "<u2"), ("start", "<u4"), ("end", "<u4")])
MOST_DOCS = 60_000  # documents numbered in two bytes within one task's hold
ANCHORS, SPANS = 0, 1
PACKED = "part int, kind int, docs binary, rows binary"
# A span of bytes found repeated, or an anchor whose strings are asked for: the one given.
FOUND = "doc_id long, mark long, span long, anchor long"


class Powers:
    """BASE and its inverse to every power that a text has needed so far."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(2 * len(self.up), n + 1)
            step = np.full(size, BASE, np.uint64)
            back = np.full(size, pow(BASE, -1, U64), np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.cumprod(step), np.cumprod(back)
        return self.up[:n], self.down[:n]


POWERS = Powers()
REMEMBERED["powers"] = POWERS.clear


class Text:
    """A text's bytes with hashes of any of its substrings."""

    def __init__(self, raw: bytes) -> None:
        x = np.frombuffer(raw, np.uint8)
        up, self.down = POWERS.to(len(x) + 1)
        self.upto = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(BYTE[x] * up[:-1], out=self.upto[1:])
        self.size = len(x)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.upto[end] - self.upto[start]) * self.down[start])

    def hashes(self, width: int) -> np.ndarray:
        """Of the substrings of one width at every place."""
        n = self.size - width + 1
        return mix64((self.upto[width:] - self.upto[:n]) * self.down[:n])


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def suffixes(text: Text, length: int) -> tuple[np.ndarray, ...]:
    """Anchors: place, first and last string start, gram, stretch, and what lies around it, side by side."""
    grams = text.hashes(GRAM)
    # The place in the low bits makes the leftmost of equal grams win.
    bits = max(1, int(text.size).bit_length())
    keyed = (grams >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(grams), dtype=np.uint64)
    at = (least_in(keyed, length - GRAM + 1) & np.uint64((1 << bits) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    place = at[first]
    step = _step(length)
    sides = []
    for i in range(SIDES):
        # What all strings share that start i * step to (i + 1) * step - 1 bytes before the anchor.
        begin, end = np.maximum(place - i * step, 0), np.minimum(place + length - (i + 1) * step + 1, text.size)
        sides.append(text.hash(begin, end))
    return place, first, last, grams[place], text.hash(first, last + length), sides


def _step(length: int) -> int:
    return -(-(length - GRAM + 1) // SIDES)


def _by_id(keys: list[tuple[int, int]], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents in order of their ids, which then lie close together, and the rows renumbered."""
    docs = np.array(keys, DOCS)
    order = np.lexsort((docs["mark"], docs["id"]))
    turn = np.empty(len(docs), "<u2")
    turn[order] = np.arange(len(docs))
    rows["doc"] = turn[rows["doc"]]
    return docs[order], rows


def _digits(batches: Iterator[pd.DataFrame], length: int, parts: int, hot: np.ndarray) -> Iterator[pd.DataFrame]:
    """First and second digits of all anchors; matches within what the task holds are settled here.

    Anchors go to parts by gram, those of ``hot`` grams by stretch.
    """
    enter("powers")
    keys: list[tuple[int, int]] = []
    held: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[pd.DataFrame]:
        docs, rows = _by_id(keys, np.concatenate(held))
        rows, later = _stretches(docs, rows)
        spans = _spans_of(rows[later], length)
        here = np.full(len(spans), TaskContext.get().partitionId() % parts)
        if len(spans):
            yield _pack(docs, spans, here, SPANS, SPAN)
        rows = rows[~later]
        by = np.where(np.isin(rows["gram"], hot), rows["run"], rows["gram"])
        yield _pack(docs, rows, by % parts, ANCHORS, SUFFIX)

    for batch in batches:
        for doc_id, mark, raw in zip(batch["doc_id"], batch["mark"], batch["raw"], strict=True):
            if raw is None or pd.isna(doc_id) or len(raw) < length:
                continue
            place, first, last, gram, run, sides = suffixes(Text(raw), length)
            rows = np.empty(len(place), SUFFIX)
            rows["gram"], rows["run"], rows["run2"] = gram & np.uint64(0xFFFFFFFF), run & np.uint64(0xFFFFFFFF), run >> np.uint64(48)
            rows["doc"], rows["at"], rows["far"], rows["near"] = len(keys), place, place - first, place - last
            for i, side in enumerate(sides):
                rows[f"side{i}"] = side >> np.uint64(48)
            keys.append((int(doc_id), int(mark)))
            held.append(rows)
            size += len(raw)
            if size >= HELD or len(keys) >= MOST_DOCS:
                yield from flush()
                keys, held, size = [], [], 0
    if held:
        yield from flush()


def _stretches(docs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of their digits and id, and which have an equal one in a smaller document."""
    ids = docs["id"][rows["doc"]]
    order = np.lexsort((ids, rows["run2"], rows["run"], rows["gram"]))
    rows, ids = rows[order], ids[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["gram"][1:] != rows["gram"][:-1]) | (rows["run"][1:] != rows["run"][:-1]) | (rows["run2"][1:] != rows["run2"][:-1])
    starts = np.flatnonzero(new)
    return rows, ids > np.repeat(ids[starts], np.diff(np.append(starts, len(rows))))


def _pack(docs: np.ndarray, rows: np.ndarray, part: np.ndarray, kind: int, form: np.dtype) -> pd.DataFrame:
    """One row per part: its rows as bytes, and the documents they name.

    Rows go in order of document and field by field, byte by byte of a number, so that
    compression finds what little order there is beside the hashes.
    """
    order = np.lexsort((rows[rows.dtype.names[-1] if kind == SPANS else "at"], rows["doc"], part))
    starts, sizes = runs(part[order])
    out = {"part": part[order][starts], "kind": kind, "docs": [], "rows": []}
    tool = zstandard.ZstdCompressor(level=1)
    for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        some = rows[order[s : s + n]]
        here, some["doc"] = np.unique(some["doc"], return_inverse=True)
        named = docs[here]
        named["id"] = np.diff(named["id"], prepend=0)  # in order, so the steps are small
        out["docs"].append(tool.compress(_to_planes(named, DOCS)))
        out["rows"].append(tool.compress(_to_planes(some.astype(form), form)))
    return pd.DataFrame(out)


def _to_planes(rows: np.ndarray, form: np.dtype) -> bytes:
    return b"".join(np.ascontiguousarray(rows[n]).view(np.uint8).reshape(len(rows), -1).T.tobytes() for n in form.names)


def _from_planes(body: bytes, form: np.dtype) -> np.ndarray:
    n, at = len(body) // form.itemsize, 0
    out = np.empty(n, form)
    for name in form.names:
        size = form[name].itemsize
        plane = np.frombuffer(body, np.uint8, n * size, at).reshape(size, n)
        out[name] = np.ascontiguousarray(plane.T).view(form[name]).ravel()
        at += n * size
    return out


def _unpack(group: pd.DataFrame, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, rows, and each row's place among the documents."""
    tool = zstandard.ZstdDecompressor()
    docs = [_from_planes(tool.decompress(b), DOCS) for b in group["docs"]]
    for some in docs:
        np.cumsum(some["id"], out=some["id"])
    rows = [_from_planes(tool.decompress(b), kind) for b in group["rows"]]
    if not docs:
        return np.zeros(0, DOCS), np.zeros(0, kind), np.zeros(0, np.int64)
    first = np.cumsum([0, *map(len, docs)])
    doc = np.concatenate([r["doc"].astype(np.int64) + f for r, f in zip(rows, first, strict=False)])
    return np.concatenate(docs), np.concatenate(rows), doc


def _spans_of(rows: np.ndarray, length: int) -> np.ndarray:
    """The merged bytes that the strings around anchors cover."""
    at = rows["at"].astype(np.int64)
    return _merged(rows["doc"].astype(np.int64), at - rows["far"], at - rows["near"] + length)


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Stretches of bytes, merged per document where they touch."""
    if not len(doc):
        return np.zeros(0, SPAN)
    order = np.lexsort((start, doc))
    lift = doc[order] << 33  # keeps documents apart
    start, end = lift + start[order], lift + end[order]
    reach = np.maximum.accumulate(end)
    at = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    out = np.empty(len(at), np.dtype([("doc", "<i8"), ("start", "<u4"), ("end", "<u4")]))
    out["doc"], out["start"] = doc[order][at], start[at] - lift[at]
    out["end"] = reach[np.append(at[1:], len(doc)) - 1] - lift[at]
    return out


def _found(docs: np.ndarray, doc: np.ndarray, values: np.ndarray, name: str) -> pd.DataFrame:
    nothing = pd.array([None] * len(doc), dtype="Int64")
    values = pd.array(values, dtype="Int64")
    both = {"span": nothing, "anchor": nothing} | {name: values}
    return pd.DataFrame({"doc_id": docs["id"][doc], "mark": docs["mark"][doc], **both})


def _as_spans(docs: np.ndarray, doc: np.ndarray, spans: np.ndarray) -> pd.DataFrame:
    return _found(docs, doc, (spans["start"].astype(np.int64) << 32) | spans["end"].astype(np.int64), "span")


def _second_digit(group: pd.DataFrame, length: int, hot: np.ndarray) -> pd.DataFrame:
    """Stretches found in a smaller document, and the anchors whose strings must be compared.

    Of equal stretches only those of the least document stand for them; an anchor is
    asked for if another document's, with the same gram, agrees in 16 bits of hash on
    a side, or if its gram is hot: then the others are elsewhere, and there are some.
    ``anchor`` packs the place and the offsets of the strings to compare.
    """
    docs, spans, doc = _unpack(group[group["kind"] == SPANS], SPAN)
    out = [_as_spans(docs, doc, spans)]
    docs, rows, doc = _unpack(group[group["kind"] == ANCHORS], SUFFIX)
    if not len(rows):
        return out[0]
    wide = rows.astype(np.dtype([(n, "<i8") if n == "doc" else (n, rows.dtype[n]) for n in rows.dtype.names]))
    wide["doc"] = doc
    wide, later = _stretches(docs, wide)
    spans = _spans_of(wide[later], length)
    out.append(_as_spans(docs, spans["doc"], spans))
    rows = wide[~later]
    ids = docs["id"][rows["doc"]]
    far, near = rows["far"].astype(np.int64), rows["near"].astype(np.int64)
    step = _step(length)
    every = np.isin(rows["gram"], hot)
    top, low_end = np.full(len(rows), -1), np.full(len(rows), 1 << 8)
    for i in range(SIDES):
        key = (rows["gram"].astype(np.int64) << 16) | rows[f"side{i}"]
        order = np.lexsort((ids, key))
        starts, sizes = runs(key[order])
        low, high = ids[order][starts], ids[order][starts + sizes - 1]
        asked = every.copy()
        asked[order] |= np.repeat(low != high, sizes)
        # Of this side's strings those that the anchor has.
        first, last = np.maximum(near, i * step), np.minimum(far, (i + 1) * step - 1)
        asked &= first <= last
        top, low_end = np.where(asked, np.maximum(top, last), top), np.where(asked, np.minimum(low_end, first), low_end)
    wanted = top >= low_end
    far, near = top, low_end
    packed = (rows["at"].astype(np.int64) << 32) | (far << 8) | near
    out.append(_found(docs, rows["doc"][wanted], packed[wanted], "anchor"))
    return pd.concat(out)


def _hot_grams(rows: DataFrame, length: int, share: int) -> np.ndarray:
    """Grams that more than about ``share`` anchors have, found on one document in ``SAMPLED``.

    There are at most as many as ``share`` goes into the number of anchors.
    """

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("powers")
        for batch in batches:
            found = [suffixes(Text(raw), length)[3] & np.uint64(0xFFFFFFFF) for raw in batch["raw"] if raw is not None and len(raw) >= length]
            if found:
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"gram": gram.astype(np.int64), "n": n})

    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)
    often = some.mapInPandas(grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return np.array(sorted(r["gram"] for r in often.where(F.col("n") * SAMPLED > share).collect()), np.int64)


def _marked(rows: DataFrame) -> DataFrame:
    """``mark`` tells rows of one id apart; where no other row has the id it is 0 and takes no room."""
    again = rows.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again"))
    few = broadcast_if_small(again)
    return rows.join(few, F.col("doc_id") == F.col("_again"), "left").select(
        "doc_id", F.when(F.col("_again").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("raw")).alias("mark"), "raw"
    )


def _packed_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts travel compressed: they are the larger part of what is dealt out by document."""
    tool = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield batch.assign(doc_id=batch["doc_id"].astype("Int64"), raw=[None if r is None else tool.compress(r) for r in batch["raw"]])


def _plain(packed: bytes | None, tool: zstandard.ZstdDecompressor) -> bytes:
    return b"" if packed is None else tool.decompress(packed)


def _strings(batches: Iterator[pd.DataFrame], length: int, parts: int) -> Iterator[pd.DataFrame]:
    """The strings around the anchors that were asked for; matches within what the task holds are settled here."""
    enter("powers")
    tool = zstandard.ZstdDecompressor()
    keys: list[tuple[int, int]] = []
    held: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[pd.DataFrame]:
        docs, rows = _by_id(keys, np.concatenate(held))
        later = _later(docs["id"][rows["doc"]], rows["key"])
        at = rows["at"][later].astype(np.int64)
        spans = _merged(rows["doc"][later].astype(np.int64), at, at + length)
        if len(spans):
            yield _pack(docs, spans, np.full(len(spans), TaskContext.get().partitionId() % parts), SPANS, SPAN)
        rows = rows[~later]
        yield _pack(docs, rows, (rows["key"] % np.uint64(parts)).astype(np.int64), ANCHORS, STRING)

    for batch in batches:
        for doc_id, mark, raw, asked in zip(batch["doc_id"], batch["mark"], batch["raw"], batch["anchors"], strict=True):
            a = np.asarray([] if asked is None else asked, np.int64)
            if not len(a):
                continue
            text, at, far, near = Text(_plain(raw, tool)), a >> 32, (a >> 8) & 255, a & 255
            start = spans_of(at - far, far - near + 1)
            some = np.empty(len(start), STRING)
            some["key"], some["doc"], some["at"] = text.hash(start, start + length), len(keys), start
            keys.append((int(doc_id), int(mark)))
            held.append(some)
            size += len(some)
            if size >= STRINGS or len(keys) >= MOST_DOCS:
                yield from flush()
                keys, held, size = [], [], 0
    if held:
        yield from flush()


def _later(ids: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which rows have an equal key in a smaller document."""
    order = np.lexsort((ids, key))
    starts, sizes = runs(key[order])
    out = np.zeros(len(key), bool)
    out[order] = ids[order] > np.repeat(ids[order][starts], sizes)
    return out


def _last_digit(group: pd.DataFrame, length: int) -> pd.DataFrame:
    """Strings that a smaller document has as well."""
    docs, spans, doc = _unpack(group[group["kind"] == SPANS], SPAN)
    settled = _as_spans(docs, doc, spans)
    docs, rows, doc = _unpack(group[group["kind"] == ANCHORS], STRING)
    later = _later(docs["id"][doc], rows["key"])
    at = rows["at"][later].astype(np.int64)
    spans = _merged(doc[later], at, at + length)
    return pd.concat([settled, _as_spans(docs, spans["doc"], spans)])


def _results(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What remains of every text once its spans are merged and taken out."""
    tool = zstandard.ZstdDecompressor()
    for batch in batches:
        out = {"starts": [], "ends": [], "n_bytes": [], "n_removed": [], "kept": []}
        for raw, first, second in zip(batch["raw"], batch["spans"], batch["more"], strict=True):
            raw = _plain(raw, tool)
            a = np.concatenate([np.asarray(x, np.int64) for x in (first, second) if x is not None] or [np.zeros(0, np.int64)])
            one = _merged(np.zeros(len(a), np.int64), a >> 32, a & 0xFFFFFFFF)
            starts, ends = one["start"].tolist(), one["end"].tolist()
            kept = b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True))
            for name, value in zip(out, (starts, ends, len(raw), len(raw) - len(kept), kept), strict=True):
                out[name].append(value)
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), **out})


RESULTS = "doc_id long, starts array<long>, ends array<long>, n_bytes long, n_removed long, kept binary"


def remove_repeats(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", share: int = SHARE) -> DataFrame:
    """``doc_id, starts, ends, n_bytes, n_removed, kept`` of every row.

    Bytes go that are covered by a ``length``-byte string which also starts in a row
    with a smaller id; ``starts`` and ``ends`` are the maximal stretches removed and
    ``kept`` the remaining bytes (they may no longer be UTF-8).
    """
    if not 2 * GRAM <= length <= 200:
        raise ValueError(f"strings of {2 * GRAM} to 200 bytes")
    width = shuffle_width(docs.sparkSession)
    parts = PARTS * width
    raw = F.col(text).cast("binary").alias("raw")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), raw)
    hot = _hot_grams(rows, length, share)
    rows = _marked(rows)
    name = ["doc_id", "mark"]
    # Digits come straight from the scan; texts are dealt out once and that exchange is read again.
    there = rows.mapInPandas(_packed_texts, "doc_id long, mark long, raw binary").repartition(width, *name)
    digits = rows.mapInPandas(lambda it: _digits(it, length, parts, hot), PACKED)
    second = digits.groupBy("part").applyInPandas(lambda g: _second_digit(g, length, hot), FOUND)
    found = second.groupBy(*name).agg(F.collect_list("span").alias("spans"), F.collect_list("anchor").alias("anchors"))
    asking = there.join(found, name, "left")
    # Both uses take the same columns of the same outer join, so its exchanges are read again, not made again.
    strings = asking.mapInPandas(lambda it: _strings(it, length, parts), PACKED)
    third = strings.groupBy("part").applyInPandas(lambda g: _last_digit(g, length), FOUND)
    more = third.groupBy(*name).agg(F.collect_list("span").alias("more"))
    every = asking.join(more, name, "left")
    return every.mapInPandas(_results, RESULTS)
