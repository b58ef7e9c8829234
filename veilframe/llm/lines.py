"""Line deduplication: a segment-partition join of lines within an edit distance.

A line is cut into ``distance + 1`` segments. Of two lines within the distance the
longer holds one of the shorter's segments unchanged, at a place that the position of
the segment, the lengths and the errors left narrow to a few. So a line enters an
index under its segments and probes it with those few substrings for every length that
may match; both are hashes, packed by key into arrays. Lines that meet and whose
letter counts are near enough become candidate pairs, and a banded bit-parallel edit
distance decides. Equal lines are one class throughout, held by its first occurrence.

Keys that would fill more than one part's share are found on a sample of lines and
dealt out in blocks of which every two meet, so nothing of them is dropped.

Defined results: lines are what stands between line feeds; blank lines are no lines and
stay; lines shorter than ``least`` characters (by default none)
are linked with equal lines only; null
text has no lines; first means least (id, text hash, line number), rows without an id
last; rows that are equal in id and text are one occurrence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import enter, fresh, mix64, runs, shuffle_width, spans_of, staged, tidy
from .substrings import POWERS
from .tokens import text_batches

DISTANCE, LEAST = 2, 1
DROPPED = 16  # characters that a line has at least to be dropped for a near one
SAMPLED, BLOCK = 64, 2048  # one line in so many is sampled for hot keys; members of a block
PARTS = 4
CLASSES = 16  # letters by code point; a line's count of each, modulo 16
BITMAP = 26
MEETINGS, HELD = 250_000, 1_000_000  # pairs compared and characters cut at a time
ENTRY = np.dtype([("key", "<u4"), ("key2", "<u2"), ("role", "u1"), ("line", "<u8"), ("counts", "<u8")])
INDEX, ONLY, PROBE = 0, 1, 2  # the second is indexed and does not meet its like
SPREAD = mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64))  # of the commoner code points
LINES = "doc_id long, mark long, line_no int, line long, counts long, short boolean"
PAIRS = "line long, counts long, line2 long, counts2 long"


class Lines:
    """All non-blank lines of some texts, as stretches of one array of code points."""

    def __init__(self, texts: list[str | None]) -> None:
        enter("powers")
        found = [(i, n, s) for i, t in enumerate(texts) if t for n, s in enumerate(t.split("\n")) if s.strip(" \t\x0b\x0c\r")]
        self.owner = np.array([f[0] for f in found], np.int64)
        self.number = np.array([f[1] for f in found], np.int32)
        self.texts = [f[2] for f in found]
        self.size = np.fromiter(map(len, self.texts), np.int64, len(found))
        self.start = np.cumsum(self.size) - self.size
        flat = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), "<u4")
        up, self.down = POWERS.to(len(flat) + 1)
        low = not len(flat) or flat.max() < len(SPREAD)
        spread = SPREAD[flat] if low else mix64(flat.astype(np.uint64) + np.uint64(1))
        spread *= up[:-1]
        self.upto = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(spread, out=self.upto[1:])
        self.line = self.hash(self.start, self.size)
        cell = np.repeat(np.arange(len(found), dtype=np.int32) * CLASSES, self.size)
        cell += flat % CLASSES
        table = np.bincount(cell, minlength=len(found) * CLASSES).reshape(-1, CLASSES)
        places = np.arange(CLASSES, dtype=np.uint64) * np.uint64(4)
        self.counts = ((table & 15).astype(np.uint64) << places).sum(1, dtype=np.uint64)

    def hash(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix64((self.upto[start + size] - self.upto[start]) * self.down[start] + size.astype(np.uint64))


def segment(size: np.ndarray, i: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and length of segment ``i`` of lines of the given sizes; later ones are longer."""
    short, longer = size // (distance + 1), size % (distance + 1)
    first_longer = distance + 1 - longer
    return i * short + np.maximum(i - first_longer, 0), short + (i >= first_longer)


def probes(distance: int) -> Iterator[tuple[int, int, int]]:
    """``(segment, size difference, shift)``: where a line may hold a shorter line's segment."""
    for i in range(distance + 1):
        for more in range(distance + 1):
            left, right = i, distance - i
            for shift in range(max(-left, more - right), min(left, more + right) + 1):
                yield i, more, shift


def entries(lines: Lines, pick: np.ndarray, distance: int, least: int = LEAST) -> np.ndarray:
    """Index and probe entries of the picked lines; the key names segment and indexed length.

    A line of at most ``distance`` characters has no segments; a longer line within the
    distance of it shares a character with it, so those meet by their single characters.
    """
    least = max(least, distance + 1)
    start, size = lines.start[pick], lines.size[pick]
    out = []

    def add(place: np.ndarray, length: np.ndarray, indexed: np.ndarray, i: int, role: int, chosen: np.ndarray) -> None:
        key = mix64(lines.hash(place, length) ^ mix64(indexed.astype(np.uint64) * np.uint64(8) + np.uint64(i)))
        rows = np.empty(len(key), ENTRY)
        rows["key"], rows["key2"], rows["role"] = key & np.uint64(0xFFFFFFFF), key >> np.uint64(48), role
        rows["line"], rows["counts"] = lines.line[chosen], lines.counts[chosen]
        out.append(rows)

    for i in range(distance + 1):
        place, length = segment(size, i, distance)
        fits = size >= least
        add((start + place)[fits], length[fits], size[fits], i, INDEX, pick[fits])
    for i, more, shift in probes(distance):
        if not more and not shift:
            continue  # two index entries meet
        indexed = size - more
        place, length = segment(indexed, i, distance)
        place = place + shift
        fits = (place >= 0) & (place + length <= size) & (indexed >= least)
        add((start + place)[fits], length[fits], indexed[fits], i, PROBE, pick[fits])
    for role, some in ((ONLY, pick[size <= distance]), (PROBE, pick[(size > distance) & (size <= 2 * distance)])):
        n = lines.size[some]
        one = np.ones(int(n.sum()), np.int64)
        add(spans_of(lines.start[some], n), one, 0 * one, 0, role, np.repeat(some, n))
    return np.concatenate(out)


def _joined(rows: np.ndarray) -> np.ndarray:
    return rows["key"].astype(np.uint64) << np.uint64(16) | rows["key2"]


def hot_keys(rows: DataFrame, distance: int, parts: int, least: int = LEAST) -> dict[int, int]:
    """Blocks per key that holds more than a part's share; at most ``parts`` keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            picked = [[s for s in (t or "").split("\n") if len(s) >= least and zlib.crc32(s.encode("utf-8", "surrogatepass")) % SAMPLED == 0] for t in batch["text"]]
            some = Lines(["\n".join(p) for p in picked])
            if not some.texts:
                continue
            _, one = np.unique(some.line, return_index=True)
            key, n = np.unique(_joined(entries(some, one, distance, least)), return_counts=True)
            yield pd.DataFrame({"key": key.astype(np.int64), "n": n})

    counted = rows.select("text").mapInPandas(tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = staged(counted)
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    found = counted.where(F.col("n") > max(BLOCK / SAMPLED, total / parts)).collect()
    return {r["key"]: int(-(-r["n"] * SAMPLED // BLOCK)) for r in found}


def _deal(rows: np.ndarray, parts: int, hot: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their parts; those of hot keys once per other block."""
    key = _joined(rows)
    part = (mix64(key) % np.uint64(parts)).astype(np.int64)
    if not hot:
        return rows, part
    hit = np.isin(key, np.fromiter(hot, np.uint64, len(hot)))
    if not hit.any():
        return rows, part
    blocks = np.array([hot[int(k)] for k in key[hit]], np.int64)
    mine = (mix64(rows["line"][hit] + np.uint64(1)) % blocks.astype(np.uint64)).astype(np.int64)
    other = spans_of(np.zeros(len(blocks), np.int64), blocks)
    again = np.repeat(np.arange(len(blocks)), blocks)
    low, high = np.minimum(mine[again], other), np.maximum(mine[again], other)
    seed = key[hit][again] ^ mix64((low * (1 << 32) + high + 1).astype(np.uint64))
    moved = rows[hit][again].copy()
    # The blocks' names go into the key as well, so that two pairs of blocks stay apart.
    moved["key"], moved["key2"] = seed & np.uint64(0xFFFFFFFF), seed >> np.uint64(48)
    return np.concatenate([rows[~hit], moved]), np.concatenate([part[~hit], (mix64(seed) % np.uint64(parts)).astype(np.int64)])


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed difference of the letter counts, each modulo 16, of two arrays of packed counts."""
    total = np.zeros(np.broadcast(a, b).shape, np.int16)
    for c in range(CLASSES):
        shift = np.uint64(4 * c)
        gap = ((a >> shift) - (b >> shift)) & np.uint64(15)
        total += np.minimum(gap, np.uint64(16) - gap).astype(np.int16)
    return total


def _meetings(group: pd.DataFrame, distance: int) -> pd.DataFrame:
    """Pairs of lines under one key, one of them indexed, whose letter counts allow the distance."""
    rows = np.concatenate([np.frombuffer(b, ENTRY) for b in group["rows"]])
    order = np.argsort(_joined(rows), kind="stable")
    rows = rows[order]
    starts, sizes = runs(_joined(rows))
    line = np.ascontiguousarray(rows["line"])
    several = np.minimum.reduceat(line, starts) != np.maximum.reduceat(line, starts) if len(line) else starts > 0
    rows = rows[np.repeat(several, sizes)]
    key = _joined(rows)
    order = np.lexsort((rows["line"], rows["role"], key))
    rows, key = rows[order], key[order]
    new = np.ones(len(rows), bool)
    new[1:] = (key[1:] != key[:-1]) | (rows["role"][1:] != rows["role"][:-1]) | (rows["line"][1:] != rows["line"][:-1])
    rows, key = rows[new], key[new]
    starts, sizes = runs(key)
    indexed = np.add.reduceat((rows["role"] != PROBE).astype(np.int64), starts) if len(rows) else sizes
    first, many = np.repeat(starts, sizes), np.where(rows["role"] == ONLY, 0, np.repeat(indexed, sizes))
    line, counts = np.ascontiguousarray(rows["line"]), np.ascontiguousarray(rows["counts"])
    upto = np.cumsum(many)
    found, at = [], 0
    while at < len(rows):
        # As many entries as meet some millions of indexed ones; a single entry may meet more.
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MEETINGS, side="right")))
        left = np.repeat(np.arange(at, stop), many[at:stop])
        right = spans_of(first[at:stop], many[at:stop])
        differ = line[left] != line[right]
        left, right = left[differ], right[differ]
        near = apart(counts[left], counts[right]) <= 2 * distance
        left, right = left[near], right[near]
        found.append(np.stack([line[left], counts[left], line[right], counts[right]], 1))
        at = stop
    pairs = _ordered(np.concatenate(found)) if found else np.zeros((0, 4), np.uint64)
    return pd.DataFrame(pairs.view(np.int64), columns=["line", "counts", "line2", "counts2"])


def _ordered(pairs: np.ndarray) -> np.ndarray:
    """Each pair once, the lesser line first."""
    swap = pairs[:, 0] > pairs[:, 2]
    pairs[swap] = pairs[swap][:, [2, 3, 0, 1]]
    pairs = pairs[np.lexsort((pairs[:, 2], pairs[:, 0]))]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(1)
    return pairs[new]


def within(a: str, b: str, distance: int) -> bool:
    """Is the edit distance at most ``distance``? Bit-parallel over the band of diagonals.

    Bits of a word are the rows of ``a`` within the band of a column of ``b``; vertical
    differences are carried from column to column. The value is followed down the
    band's lowest diagonal to the last row of ``a``, then along that row.
    """
    if abs(len(a) - len(b)) > distance:
        return False
    if len(a) > len(b):
        a, b = b, a
    low = 0
    while low < len(a) and a[low] == b[low]:
        low += 1
    high = 0
    while high < len(a) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    m, n, k = len(a), len(b), distance
    if not m or n <= k:
        return n <= k
    width = 2 * k + 1
    full = (1 << width) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, value = full & ~((1 << k) - 1), 0, min(k, m)
    lowest = 1 << (2 * k)
    for j in range(1, n + 1):
        place = j - k - 1  # of the band's first row
        same = where.get(b[j - 1], 0)
        same = (same >> place if place >= 0 else same << -place) & full
        zero = ((((same & up) + up) ^ up) | same | down) & full
        right, left = (down | ~(zero | up)) & full, zero & up
        if j + k <= m:
            value += not zero & lowest
        else:
            bit = 1 << (m - place - 1)
            value += bool(right & bit) - bool(left & bit)
        up, down = (left | ~((zero >> 1) | right)) & full, (zero >> 1) & right
        if value - (n - max(j, m - k)) > k:  # each step left along the last row takes off one at most
            return False
    return value <= k


def _bitmap(marks: DataFrame) -> np.ndarray:
    """2^BITMAP bits of which those of the given texts are set: at most 8 MB on the driver."""
    slot = F.shiftrightunsigned("mark", 64 - BITMAP)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    words = marks.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    out = np.zeros(1 << (BITMAP - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def links(rows: DataFrame, every: DataFrame, distance: int, least: int = LEAST) -> DataFrame:
    """``line, counts, line2, counts2``: classes of lines within the distance, each pair once.

    Lines of at most ``distance`` characters are all within it and are not listed in pairs.

    ``rows`` has ``text, mark`` and ``every`` all lines by ``LINES``. Only texts that hold
    a candidate line are cut again, which a bitmap of fixed size tells.
    """
    spark = rows.sparkSession
    parts = PARTS * shuffle_width(spark)
    hot = hot_keys(rows, distance, parts, least)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in text_batches(texts, HELD):
                some = Lines(texts[a:b])
                _, one = np.unique(some.line, return_index=True)
                one = one[some.size[one] >= least]
                if not len(one):
                    continue
                found, part = _deal(entries(some, one, distance, least), parts, hot)
                order = np.argsort(part, kind="stable")
                starts, sizes = runs(part[order])
                yield pd.DataFrame(
                    {"part": part[order][starts], "rows": [found[order[s : s + n]].tobytes() for s, n in zip(starts, sizes, strict=True)]}
                )

    packed = rows.select("text").mapInPandas(tidy(cut), "part int, rows binary")
    pairs = staged(packed.groupBy("part").applyInPandas(lambda g: _meetings(g, distance), PAIRS).distinct())
    ends = pairs.select("line", "counts").unionByName(pairs.select(F.col("line2").alias("line"), F.col("counts2").alias("counts")))
    ends = staged(ends.distinct())
    wanted = spark.sparkContext.broadcast(_bitmap(every.join(ends, ["line", "counts"], "left_semi").select("mark")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slot = batch["mark"].to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP)
            hit = (wanted.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
            texts = batch["text"][hit.astype(bool)].tolist()
            for a, b in text_batches(texts, HELD):
                some = Lines(texts[a:b])
                _, one = np.unique(some.line, return_index=True)
                if len(one):
                    yield pd.DataFrame(
                        {"line": some.line[one].view(np.int64), "counts": some.counts[one].view(np.int64), "text": [some.texts[i] for i in one]}
                    )

    read_back = rows.select("text", "mark").mapInPandas(tidy(read), "line long, counts long, text string")
    texts = staged(read_back.join(ends, ["line", "counts"], "left_semi").dropDuplicates(["line", "counts"]))
    second = texts.select(F.col("line").alias("line2"), F.col("counts").alias("counts2"), F.col("text").alias("text2"))
    both = pairs.join(texts, ["line", "counts"]).join(second, ["line2", "counts2"])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = [within(a, b, distance) for a, b in zip(batch["text"], batch["text2"], strict=True)]
            yield batch.loc[near, ["line", "counts", "line2", "counts2"]]

    return both.mapInPandas(tidy(decide), PAIRS)


def line_classes(docs: DataFrame, distance: int = DISTANCE, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """One row per non-blank line.

    ``doc_id, mark, line_no``, its class' first occurrence ``class_doc_id, class_line_no``,
    ``n_links`` other classes within the distance, and ``removed``: it is not the first of
    its class, or its class is linked with one that occurs earlier.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, marks, texts = batch["doc_id"].astype("Int64"), batch["mark"].to_numpy(), batch["text"].tolist()
            for a, b in text_batches(texts, HELD):
                some = Lines(texts[a:b])
                yield pd.DataFrame(
                    {
                        "doc_id": ids.iloc[a + some.owner].to_numpy() if len(some.owner) else pd.array([], "Int64"),
                        "mark": marks[a + some.owner],
                        "line_no": some.number,
                        "line": some.line.view(np.int64),
                        "counts": some.counts.view(np.int64),
                        "short": (some.size >= least) & (some.size <= distance),
                    }
                )

    every = staged(rows.mapInPandas(tidy(number), LINES))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "line_no")
    classes = staged(every.groupBy("line", "counts").agg(F.min(place).alias("first"), F.bool_or("short").alias("short")))
    linked = staged(links(rows, every, distance, least))
    turned = linked.select(
        F.col("line2").alias("line"), F.col("counts2").alias("counts"), F.col("line").alias("line2"), F.col("counts").alias("counts2")
    )
    other = classes.select(F.col("line").alias("line2"), F.col("counts").alias("counts2"), F.col("first").alias("before"))
    near = linked.unionByName(turned).join(other, ["line2", "counts2"])
    near = near.groupBy("line", "counts").agg(F.count("*").alias("n_links"), F.min("before").alias("before"))
    # Each of the short classes is linked with all others of them.
    mates = classes.where("short").agg(F.count("*").alias("n_short"), F.min("first").alias("short_first"))
    held = classes.join(near, ["line", "counts"], "left").crossJoin(F.broadcast(mates))
    held = held.select(
        "line",
        "counts",
        "first",
        (F.coalesce("n_links", F.lit(0)) + F.when(F.col("short"), F.col("n_short") - 1).otherwise(0)).alias("n_links"),
        F.least("before", F.when(F.col("short"), F.col("short_first"))).alias("before"),
    )
    out = every.drop("short").withColumn("place", place).join(held, ["line", "counts"])
    return out.select(
        "doc_id",
        "mark",
        "line_no",
        F.col("first.doc_id").alias("class_doc_id"),
        F.col("first.line_no").alias("class_line_no"),
        F.col("n_links").cast("long").alias("n_links"),
        ((F.col("place") != F.col("first")) | F.coalesce(F.col("before") < F.col("first"), F.lit(False))).alias("removed"),
    )


def drop_lines(docs: DataFrame, distance: int = DISTANCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without their removed lines; a row that loses every line goes.

    Lines under ``DROPPED`` characters go for equal ones only: '1.' is not a copy of '2.'.

    Rows without any line stay as they are, and so do all other columns.
    """
    found = line_classes(docs, distance, key, text, DROPPED)
    gone, mark, owner, whole = (fresh(docs, n) for n in ("_gone", "_mark", "_owner", "_whole"))
    by_doc = (
        found.groupBy("doc_id", "mark")
        .agg(F.array_sort(F.collect_set(F.when(F.col("removed"), F.col("line_no")))).alias(gone), F.bool_and("removed").alias(whole))
        .where(F.size(gone) > 0)
        .select(F.col("doc_id").alias(owner), F.col("mark").alias(mark), gone, whole)
    )
    same = F.col(key).cast("long").eqNullSafe(F.col(owner)) & (F.xxhash64(text) == F.col(mark))
    joined = docs.join(by_doc, same, "left").where(~F.coalesce(whole, F.lit(False)))
    left = F.filter(F.split(F.col(text), "\n", -1), lambda s, i: ~F.array_contains(F.col(gone), i))
    columns = [F.when(F.col(gone).isNull(), F.col(f"`{c}`")).otherwise(F.array_join(left, "\n")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns)
