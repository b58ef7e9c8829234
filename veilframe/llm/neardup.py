"""MinHash near-duplicates by fast similarity sketching, banding and exact checks.

A text's set is its distinct word windows. A sketch throws the set into bins by a new
hash in each round, keeps the least of the first round that reaches a bin, and after as
many rounds as bins lets every round fill a bin of its own: each coordinate is filled,
in about one pass for long texts, and coordinates agree as often as the sets do, with
the concentration of independent ones.

Equal sets are one class. Classes that share a band are compared in blocks by their
sketches; pairs under ``SURE`` agreeing coordinates cannot reach the threshold (six
standard deviations) and the rest, as a spanning forest, give clusters. Inside a
cluster sets are intersected in full, again in blocks, and only confirmed links make
components. No pairs are listed: a block gives at most one edge per member.

Defined results: null, empty and blank texts have empty sets and are linked with
nothing; a text of fewer words than a window is one window; rows that share an id are
linked each by its own text; rows without an id are linked as others, but never name a
component, and are kept where no row with an id is in theirs; long texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import enter, fresh, mix64, shuffle_width, staged, tidy
from .links import components, forest, paired_blocks, whole_groups
from .tokens import text_batches
from .words import shingle_sets, word_codes

BIN_BITS, BANDS, ROWS = 7, 32, 4
BINS = 1 << BIN_BITS
# Of 128 coordinates at similarity 0.8: mean 102.4, standard deviation 4.5.
SURE = 75
SPREAD = 800  # hashes per pass over a set; short sets take several rounds at once
BLOCK, BLOCK_SHINGLES = 256, 2_000_000
COLUMNS = 4096
SEEDS = mix64(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
SKETCHES = "doc_id long, text_hash long, n_shingles long, digest binary, sketch binary, bands array<long>"
SETS = "cluster binary, node binary, n long, shingles binary"


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit coordinate per bin: bin, round and hash of the least element there."""
    out = np.zeros(BINS, np.uint64)
    empty = np.ones(BINS, bool)
    step, first = max(1, -(-SPREAD // len(shingles))), 0
    while first < BINS and empty.any():
        turn = np.arange(first, min(first + step, BINS))
        z = mix64(shingles[None, :] ^ SEEDS[turn, None])
        keys = (z & ~np.uint64((1 << 57) - 1)) | (turn[:, None].astype(np.uint64) << np.uint64(49)) | (z & np.uint64((1 << 49) - 1))
        keys = np.sort(keys, axis=None)
        bins = (keys >> np.uint64(57)).astype(np.int64)
        lead = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        lead = lead[empty[bins[lead]]]
        out[bins[lead]] = keys[lead]
        empty[bins[lead]] = False
        first += step
    for b in np.flatnonzero(empty):
        out[b] = mix64(shingles ^ SEEDS[BINS + b]).min()
    return out


def bands_of(coordinates: np.ndarray) -> np.ndarray:
    rows = coordinates.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix64(key * np.uint64(31) + rows[:, r])
    return key.view(np.int64)


def _sets(texts: list, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Index and set of every text."""
    enter("sets")
    for a, b in text_batches(texts):
        words, counts = word_codes(texts[a:b], xxhash.xxh64_intdigest)
        yield from enumerate(shingle_sets(words, counts, width), a)


def sketches(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, digests, prints, bands = [], [], [], []
            for _, found in _sets(batch["text"].tolist(), width):
                sizes.append(len(found))
                if not len(found):
                    digests.append(None), prints.append(None), bands.append(None)
                    continue
                coordinates = sketch(found)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                prints.append((mix64(coordinates) >> np.uint64(56)).astype(np.uint8).tobytes())
                bands.append(bands_of(coordinates))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "n_shingles": sizes, "digest": digests, "sketch": prints, "bands": bands})

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInPandas(tidy(run), SKETCHES)


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """Forest edges ``a, b`` between classes that share a band and agree in enough coordinates."""
    keyed = nodes.select("node", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = keyed.join(shared, "band").join(nodes.select("node", "sketch"), "node")
    dealt = paired_blocks(members, "band", F.ceil(F.col("n") / BLOCK).cast("int"), "node")
    order = ["band", "i", "j"]
    width = shuffle_width(nodes.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts, sizes in whole_groups(batches, order):
            ids = frame["node"].to_numpy()
            prints = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(ids), BINS)
            two = starts[sizes == 2]
            two = two[(prints[two] == prints[two + 1]).sum(1) >= SURE]
            yield pd.DataFrame({"a": ids[two], "b": ids[two + 1]})
            for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own, held = ids[start : start + size], prints[start : start + size]
                near = np.zeros((size, size), bool)
                for i in range(size):
                    near[i] = (held[i] == held).sum(1) >= SURE
                child, parent = forest(near)
                yield pd.DataFrame({"a": own[child], "b": own[parent]})

    ready = dealt.select("node", "sketch", *order).repartition(width, *order).sortWithinPartitions(*order)
    return ready.mapInPandas(tidy(run), "a binary, b binary").distinct()


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of blocks of the membership matrix."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, last, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def confirmed_edges(clusters: DataFrame, docs: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """Forest edges of the links that full sets confirm.

    ``clusters`` has ``node, component, n_shingles`` and the row to read a node's text
    from: ``doc_id, text_hash, copies``.
    """
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("text"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("text") == F.col("text_hash"))
    wanted = rows.join(clusters, same).select("node", "component", "text")
    if not clusters.where("copies > 1").isEmpty():
        wanted = wanted.dropDuplicates(["node"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [s for _, s in _sets(batch["text"].tolist(), width)]
            yield pd.DataFrame({"cluster": batch["component"], "node": batch["node"], "n": [len(s) for s in found], "shingles": [s.tobytes() for s in found]})

    sets = wanted.mapInPandas(tidy(cut), SETS).where("n > 0")
    sizes = clusters.groupBy("component").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("total"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    sized = sets.join(sizes.select(F.col("component").alias("cluster"), blocks.alias("nb")), "cluster")
    order = ["cluster", "i", "j"]
    dealt = paired_blocks(sized, "cluster", F.col("nb"), "node").select("node", "n", "shingles", *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts, counts in whole_groups(batches, order):
            nodes, sets, lengths = frame["node"].to_numpy(), frame["shingles"].to_numpy(), frame["n"].to_numpy()
            a, b = [], []
            for start, count in zip(starts[counts > 1].tolist(), counts[counts > 1].tolist(), strict=True):
                found = [np.frombuffer(s, np.uint64) for s in sets[start : start + count]]
                size = lengths[start : start + count]
                both = intersections(found)
                child, parent = forest(100 * both >= percent * (size[:, None] + size[None, :] - both))
                a += nodes[start + child].tolist()
                b += nodes[start + parent].tolist()
            if a:
                yield pd.DataFrame({"a": a, "b": b})

    ready = dealt.repartition(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order)
    return ready.mapInPandas(tidy(run), "a binary, b binary")


def _grouped(docs: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, group`` of every row; no group without shingles."""
    found = staged(sketches(docs, width, key, text))
    real = found.where("n_shingles > 0")
    source = F.struct("doc_id", "text_hash")
    least = real.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min(source).alias("at"))
    classes = staged(least.select(F.col("digest").alias("node"), "least", "at"))
    reads = (F.col("doc_id").eqNullSafe(F.col("at.doc_id"))) & (F.col("text_hash") == F.col("at.text_hash"))
    firsts = real.join(classes, F.col("digest") == F.col("node")).where(reads)
    # One row per class: the sketch is a function of the set, so any of its rows will do.
    counted = firsts.groupBy("node").agg(F.count("*").alias("copies"))
    one = firsts.dropDuplicates(["node"]).select("node", "n_shingles", "sketch", "bands", "doc_id", "text_hash")
    nodes = staged(one.join(counted, "node"))
    clusters = components(candidate_edges(nodes))
    reading = nodes.select("node", "n_shingles", "doc_id", "text_hash", "copies")
    sized = staged(clusters.join(reading, "node"))
    groups = components(confirmed_edges(sized, docs, width, percent, key, text))
    named = classes.join(groups, "node", "left").select("node", "least", F.coalesce("component", "node").alias("group"))
    firsts_of = named.groupBy("group").agg(F.min("least").alias("component_id"))
    labels = named.join(firsts_of, "group").select("node", "component_id", "group")
    out = found.join(labels, F.col("digest") == F.col("node"), "left")
    component = F.when(F.col("group").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), "group")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    out = _grouped(docs, width, percent, key, text)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, the one of the least id (null ids last); columns as they were.

    A row is known by its id and its text: a row without an id, or one that shares its
    id, goes only by what its own text says, and of rows equal in both one stays. Rows
    without a word are in no group and all stay.
    """
    found = staged(_grouped(docs, width, percent, key, text).where("group IS NOT NULL").select("doc_id", "text_hash", "group"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_no_id"), "doc_id", "text_hash")).alias("first")
    firsts = staged(found.groupBy("group").agg(first).select("first.doc_id", "first.text_hash"))
    names = [fresh(docs, n) for n in ("_id", "_text", "_turn")]
    same = F.col(f"`{key}`").cast("long").eqNullSafe(F.col(names[0])) & F.xxhash64(text).eqNullSafe(F.col(names[1]))

    def named(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("doc_id").alias(names[0]), F.col("text_hash").alias(names[1]))

    gone = found.select("doc_id", "text_hash").distinct().join(firsts, ["doc_id", "text_hash"], "left_anti")
    lost = firsts.where("doc_id IS NULL")  # a plain join would not meet them
    gone = gone.join(lost, gone["doc_id"].isNull() & (gone["text_hash"] == lost["text_hash"]), "left_anti")
    # Stored, so their size is known: where they are few, the documents stay where they are.
    left = docs.join(staged(named(gone)), same, "left_anti")
    again = staged(named(found.groupBy("doc_id", "text_hash").count().where("count > 1")))
    if again.isEmpty():
        return left
    once = Window.partitionBy(*[F.col(n) for n in names[:2]]).orderBy(F.lit(0))
    repeated = left.join(again, same).withColumn(names[2], F.row_number().over(once)).where(F.col(names[2]) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return left.join(again, same, "left_anti").select(*columns).unionByName(repeated.select(*columns))
