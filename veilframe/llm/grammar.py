"""Re-Pair token files: ids per block as a grammar, readable at any document.

Documents in id order are tokenized and cut into blocks of whole documents. In a
block, rounds replace frequent neighbouring id pairs by new symbols until a round
saves too little: a round takes every pair that is frequent enough, and where two
occurrences overlap the more frequent pair wins. A block file holds the rules round
by round, the length every rule expands to, the sequence, and the expanded place of
every 64th symbol and of each document, so one document is decoded alone.

Files are Parquet rows with one block each (partition, number, ids, bytes), written
and read by Spark, so any store works. Null and empty text is the end id alone;
repeated rows are written as often as they occur; no rows give files without blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import runs, spans_of
from .packing import in_order
from .tokens import encoder, text_batches

BLOCK = 1 << 19
LEAST_COUNT = 8  # a rule costs three numbers, so rarer pairs do not pay
ROUNDS, LEAST_GAIN = 6, 0.03
MARK_EVERY = 64
SLOT_BITS = 17
MAGIC = b"VFG1"
HEAD = struct.Struct("<4sIIIIIQ")  # magic, documents, rounds, rules, symbols, first new symbol, ids
BLOCKS = "part int, block int, n_ids long, body binary"
TOKENS = "part int, block int, doc_id long, local long, n_tokens long, ids_crc32 long"


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _replace(seq: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: the shorter sequence and the pairs it now names, most frequent first."""
    keys = seq[:-1].astype(np.int64) << 24 | seq[1:]
    starts, counts = runs(ordered := np.sort(keys))
    often = counts >= LEAST_COUNT
    pairs, counts = ordered[starts[often]], counts[often]
    none = np.zeros((0, 2), np.uint32)
    if not len(pairs):
        return seq, none
    # Rank by count, then by pair. Ranks are found by a hashed slot; of pairs that share
    # a slot the most frequent has it, and the others wait for the next round.
    by_count = np.argsort(-counts, kind="stable")
    ranked = pairs[by_count]
    rank = np.full(1 << SLOT_BITS, len(pairs), np.int32)
    owner = np.full(1 << SLOT_BITS, -1, np.int64)
    rank[_slot(ranked[::-1])] = np.arange(len(pairs) - 1, -1, -1, dtype=np.int32)
    owner[_slot(ranked[::-1])] = ranked[::-1]
    slots = _slot(keys)
    at = np.where(owner[slots] == keys, rank[slots], np.int32(len(pairs)))
    left = np.concatenate([[len(pairs) + 1], at[:-1]])
    right = np.concatenate([at[1:], [len(pairs) + 1]])
    hit = np.flatnonzero((at < len(pairs)) & (at < left) & (at <= right))
    used = np.bincount(at[hit], minlength=len(pairs))
    keep = used >= LEAST_COUNT // 2
    hit = hit[keep[at[hit]]]
    name = np.cumsum(keep) - 1
    out = seq.copy()
    out[hit] = symbols + name[at[hit]]
    stay = np.ones(len(seq), bool)
    stay[hit + 1] = False
    chosen = ranked[keep]
    return out[stay], np.stack([chosen >> 24, chosen & 0xFFFFFF], 1).astype(np.uint32)


def _expand(table: tuple[np.ndarray, np.ndarray, np.ndarray], symbols: np.ndarray) -> np.ndarray:
    flat, starts, sizes = table
    return flat[spans_of(starts[symbols], sizes[symbols])]


def _grow(table: tuple[np.ndarray, np.ndarray, np.ndarray], rules: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Append what the rules of one round expand to."""
    flat, starts, sizes = table
    new = sizes[rules[:, 0]] + sizes[rules[:, 1]]
    tail = _expand(table, rules.ravel())
    return (
        np.concatenate([flat, tail]),
        np.concatenate([starts, len(flat) + np.cumsum(new) - new]),
        np.concatenate([sizes, new]),
    )


def _terminals(first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.arange(first, dtype=np.uint32), np.arange(first), np.ones(first, np.int64)


def encode_block(doc_ids: list, ids: np.ndarray, sizes: np.ndarray, rounds: int = ROUNDS) -> bytes:
    """``doc_ids`` may hold None; ``sizes`` are the documents' id counts, in order."""
    first = int(ids.max()) + 1 if len(ids) else 0
    seq, symbols, grammar = ids.astype(np.uint32), first, []
    lengths = np.ones(first, np.int64)
    for _ in range(rounds):
        if len(seq) < 2 * LEAST_COUNT:
            break
        shorter, rules = _replace(seq, symbols)
        if not len(rules) or symbols + len(rules) >= 1 << 24:
            break
        gain = len(seq) - len(shorter)
        seq, symbols = shorter, symbols + len(rules)
        grammar.append(rules)
        lengths = np.concatenate([lengths, lengths[rules[:, 0]] + lengths[rules[:, 1]]])
        if gain < LEAST_GAIN * len(seq):
            break
    upto = np.cumsum(lengths[seq]) if len(seq) else np.zeros(0, np.int64)
    marks = np.concatenate([[0], upto])[:-1][::MARK_EVERY] if len(seq) else upto
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [
        HEAD.pack(MAGIC, len(doc_ids), len(grammar), symbols - first, len(seq), first, len(ids)),
        np.array([len(r) for r in grammar], "<u4").tobytes(),
        *[r.astype("<u4").tobytes() for r in grammar],
        lengths[first:].astype("<u4").tobytes(),
        marks.astype("<u8").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        known.tobytes(),
        sizes.astype("<u8").tobytes(),
        seq.astype("<u2").tobytes(),
        (seq >> 16).astype(np.uint8).tobytes(),
    ]
    return b"".join(parts)


class Block:
    """A block file read back."""

    def __init__(self, body: bytes) -> None:
        magic, docs, rounds, rules, length, self.first, self.n_ids = HEAD.unpack_from(body)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = HEAD.size

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        counts = read("<u4", rounds)
        self.rules = [read("<u4", 2 * int(n)).reshape(-1, 2) for n in counts]
        self.lengths = read("<u4", rules)
        self.marks = read("<u8", -(-length // MARK_EVERY))
        ids, known = read("<i8", docs), read("u1", docs)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.sizes = read("<u8", docs).astype(np.int64)
        self.seq = read("<u2", length).astype(np.uint32) | read("u1", length).astype(np.uint32) << 16
        self.starts = np.cumsum(self.sizes) - self.sizes

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = _terminals(self.first)
        for rules in self.rules:
            out = _grow(out, rules)
        return out

    def ids(self) -> np.ndarray:
        return _expand(self.table(), self.seq)

    def document(self, i: int) -> np.ndarray:
        """One document's ids: only the symbols over its stretch are expanded."""
        start, size = int(self.starts[i]), int(self.sizes[i])
        mark = int(np.searchsorted(self.marks, start, side="right")) - 1
        left = self.seq[mark * MARK_EVERY :]
        spread = np.where(left < self.first, 1, self.lengths[np.maximum(left.astype(np.int64) - self.first, 0)] if len(self.lengths) else 1)
        upto = np.cumsum(spread)
        skip = start - int(self.marks[mark])
        some = left[: int(np.searchsorted(upto, skip + size)) + 1]
        while (some >= self.first).any():
            pairs = np.concatenate(self.rules)
            wide = some >= self.first
            out = np.repeat(some, 1 + wide)
            where = np.cumsum(1 + wide) - 1 - wide
            chosen = pairs[some[wide] - self.first]
            out[where[wide]], out[where[wide] + 1] = chosen[:, 0], chosen[:, 1]
            some = out
        return some[skip : skip + size]


def write_blocks(docs: DataFrame, path: str, vocabulary: str, end: int = 2, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> None:
    """Tokenize and write all documents in ascending id order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, part, number = encoder(vocabulary, False, end), TaskContext.get().partitionId(), 0
        keys, ids, sizes, held = [], [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal number, keys, ids, sizes, held
            flat = np.concatenate(ids)
            body = encode_block(keys, flat, np.concatenate(sizes))
            row = pd.DataFrame({"part": [part], "block": [number], "n_ids": [len(flat)], "body": [body]})
            keys, ids, sizes, held = [], [], [], 0
            number += 1
            return row

        for batch in batches:
            names, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for a, b in text_batches(texts):
                flat, counts = tool.encode(texts[a:b])
                keys += [None if pd.isna(k) else int(k) for k in names[a:b]]
                ids.append(flat)
                sizes.append(counts)
                held += len(flat)
                if held >= block:
                    yield flush()
        if held:
            yield flush()

    in_order(docs, key, text).mapInPandas(run, BLOCKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, number, body in zip(batch["part"], batch["block"], batch["body"], strict=True):
                held = Block(body)
                raw = held.ids().astype("<u4").tobytes()
                ends = held.starts + held.sizes
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(held.starts.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame(
                    {
                        "part": part,
                        "block": number,
                        "doc_id": pd.array(held.doc_ids, dtype="Int64"),
                        "local": held.starts,
                        "n_tokens": held.sizes,
                        "ids_crc32": sums,
                    }
                )

    files = spark.read.schema(BLOCKS).parquet(path)
    # One row per range partition and one per block: the catalogue of the files.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = files.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("first"))
    places = blocks.join(bases, "part").select("part", "block", (F.col("base") + F.col("first")).alias("first"))
    return files.mapInPandas(decode, TOKENS).join(places, ["part", "block"]).select(
        "doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )
