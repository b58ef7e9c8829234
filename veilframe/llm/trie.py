"""Prefix trie of conversations, with totals of its subtrees.

Every conversation is its turns in order (turn, then role and text; nulls first), after
an exchange of its beginning: its first h turns are replaced by those of a conversation
``stride`` ids share, h being the crc32 of its id modulo ``depths``. A node is a distinct
sequence of first turns; it has the conversations that begin so as members and is named
by the least of them and its depth.

A sequence is known by 128 bits: the sum, part by part, of hashes of its turns and their
places, so a prefix is a running sum, taken over blocks of a conversation and then over
its blocks: a conversation of any length is spread over tasks. Members that end at a
node are numbered, joined in pieces and hashed piece after piece. What depends on whole
subtrees is summed by centroid decomposition.

Rows without an id belong to no conversation; null role or text is empty; equal rows
are turns of their own; a conversation whose turns are all exchanged for none is a
member of the root alone; without conversations there is no node. Other columns take
no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounded import broadcast_if_small
from .centroids import LIMIT, rollup
from .common import staged, word_count
from .order import numbered, same_keys

STRIDE, DEPTHS = 20, 4
BLOCK = 4096  # turns of a conversation, or ends of a node, that go to one task together
KEY = ["k0", "k1", "k2", "k3"]
HOT = 10_000  # children of a node that ask for it in one task
EMPTY = hashlib.sha256(b"").hexdigest()


def _parts(hexes: Column) -> list[Column]:
    return [F.conv(F.substring(hexes, 1 + 8 * i, 8), 16, 10).cast("long").alias(k) for i, k in enumerate(KEY)]


def rebuilt(turns: DataFrame, stride: int = STRIDE, depths: int = DEPTHS) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv_id, pos, mark, words, length`` after the exchange, and ``conv_id, length``."""
    own = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    counts = staged(own.groupBy("conv_id").agg(F.count("*").alias("own")))
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(depths))
    plans = counts.select("conv_id", (F.col("conv_id") - F.col("conv_id") % stride).alias("base"), heads.alias("head"), "own")
    there = counts.select(F.col("conv_id").alias("_base"), F.col("own").alias("_theirs"))
    plans = plans.join(there, F.col("base") == F.col("_base"), "left")
    lent = F.least("head", F.coalesce("_theirs", F.lit(0)))
    length = lent + F.greatest(F.col("own") - F.col("head"), F.lit(0))
    plans = staged(plans.select("conv_id", "base", "head", lent.alias("lent"), length.alias("length")))

    placed = numbered(own, ["conv_id"], ["turn", "role", "text"], "at", facts=plans)
    size = F.octet_length("role").cast("string")
    mark = F.md5(F.concat(size, F.lit(":"), "role", "text").cast("binary"))
    narrow = staged(placed.select("conv_id", "at", "head", "lent", "length", mark.alias("mark"), word_count(F.col("text")).alias("words")))
    kept = narrow.where("at >= head").select("conv_id", (F.col("at") - F.col("head") + F.col("lent")).alias("pos"), "mark", "words", "length")
    # At most ``stride`` conversations of either sign share a base, and it lends fewer than ``depths`` turns.
    lends = narrow.where((F.col("at") < depths) & (F.col("conv_id") % stride == 0)).select(F.col("conv_id").alias("_base"), F.col("at").alias("pos"), "mark", "words")
    taken = plans.join(lends, (F.col("base") == F.col("_base")) & (F.col("pos") < F.col("head")))
    return kept.unionByName(taken.select("conv_id", "pos", "mark", "words", "length")), plans.select("conv_id", "length")


def _prefixes(turns: DataFrame, block: int) -> DataFrame:
    """The turns with the key of the sequence up to them (KEY) and before them (_KEY)."""
    seen = turns.select("conv_id", "pos", "words", "length", F.floor(F.col("pos") / block).alias("block"), *_parts(F.md5(F.concat(F.col("pos").cast("string"), F.lit(":"), "mark").cast("binary"))))
    seen = staged(seen)
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = seen.select("conv_id", "pos", "words", "length", "block", *[F.col(k).alias(f"own_{k}") for k in KEY], *[F.sum(k).over(upto).alias(k) for k in KEY])
    # Only conversations of several blocks carry anything over.
    totals = seen.where(F.col("length") > block).groupBy("conv_id", "block").agg(*[F.sum(k).alias(k) for k in KEY])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), *[F.sum(k).over(before).alias(f"more_{k}") for k in KEY])
    both = local.join(carried, (F.col("conv_id") == F.col("_conv")) & (F.col("block") == F.col("_block")), "left")
    full = {k: F.col(k) + F.coalesce(F.col(f"more_{k}"), F.lit(0)) for k in KEY}
    wrap = 1 << 32
    return both.select(
        "conv_id", "words", "length", (F.col("pos") + 1).alias("depth"),
        *[F.pmod(full[k], F.lit(wrap)).alias(k) for k in KEY],
        *[F.pmod(full[k] - F.col(f"own_{k}"), F.lit(wrap)).alias(f"_{k}") for k in KEY],
    )


def _ends(rows: DataFrame, block: int) -> DataFrame:
    """SHA-256 per key of its conversation ids in order, joined by commas."""
    placed = numbered(staged(rows), KEY, ["conv_id"], "place")
    pieces = placed.withColumn("piece", F.floor(F.col("place") / block)).groupBy(*KEY, "piece")
    joined = pieces.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None

        def done() -> pd.DataFrame:
            return pd.DataFrame([[*now, state.hexdigest()]], columns=[*KEY, "ends_sha256"])

        for batch in batches:
            out = []
            for *key, ids in zip(*[batch[k] for k in KEY], batch["ids"], strict=True):
                if key != now:
                    if now is not None:
                        out.append(done())
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pd.concat(out)
        if now is not None:
            yield done()

    dealt = joined.repartition(*KEY).sortWithinPartitions(*KEY, "piece")
    return dealt.mapInPandas(fold, ", ".join(f"{k} long" for k in KEY) + ", ends_sha256 string")


def trie(turns: DataFrame, stride: int = STRIDE, depths: int = DEPTHS, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, turn, role, text)."""
    rows, convs = rebuilt(turns, stride, depths)
    rows = staged(_prefixes(rows, block))
    over = [f"_{k}" for k in KEY]
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    first = top.first()
    root = [F.lit(0).cast("long").alias(k) for k in KEY]
    nodes = rows.groupBy(*KEY, *over, "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    nowhere = [F.lit(None).cast("long").alias(k) for k in over]
    nodes = nodes.unionByName(top.select(*root, *nowhere, F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words")))
    children = nodes.where("depth > 0").groupBy(*over).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children.select(*[F.col(k).alias(f"_{k}") for k in over], "n_children"), same_keys(KEY, [f"_{k}" for k in over]), "left")
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("depth").cast("string"))
    columns = [*KEY, *over, "depth", "conv_id", "n_convs", "words", F.coalesce("n_children", F.lit(0)).alias("n_children"), name.alias("node")]
    nodes = staged(nodes.select(*columns))

    # Nodes at depth 1 know their parent, the root; the others look theirs up, hot ones as several copies.
    parents = nodes.where("depth > 0").select(*[F.col(k).alias(f"__{k}") for k in KEY], F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_uses"))
    deep = _parents(nodes.where("depth > 1"), over, parents)
    shallow = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(first["conv_id"] if first else None).cast("long"))
    alone = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    linked = staged(deep.unionByName(shallow).unionByName(alone))

    above = F.when(F.col("depth") > 0, F.concat_ws(":", F.col("parent_conv_id").cast("string"), (F.col("depth") - 1).cast("string")))
    forest = linked.select(
        "node", above.alias("parent"), (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    sums = rollup(forest, ["n_leaves", "saved_tokens"], limit)
    last = rows.where("depth = length").select(*KEY, "conv_id").unionByName(convs.where("length = 0").select(*root, "conv_id"))
    ends = _ends(last, block).select(*[F.col(k).alias(f"__{k}") for k in KEY], "ends_sha256")
    full = linked.join(ends, same_keys(KEY, [f"__{k}" for k in KEY]), "left").join(sums, "node")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def _parents(nodes: DataFrame, over: list[str], parents: DataFrame) -> DataFrame:
    """``nodes`` with ``parent_conv_id``; parents of many are repeated and the asking dealt over the copies."""
    theirs = [f"_{k}" for k in over]
    parts = F.ceil(F.col("_uses") / HOT)
    hot = broadcast_if_small(parents.where(F.col("_uses") > HOT).select(*[F.col(k).alias(f"hot{k}") for k in theirs], parts.alias("_parts")))
    dealt = nodes.join(hot, same_keys(over, [f"hot{k}" for k in theirs]), "left")
    dealt = dealt.select(*nodes.columns, F.coalesce(F.pmod(F.xxhash64("node"), F.col("_parts")), F.lit(0)).alias("_turn"))
    many = parents.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1)) - 1)).alias("_copy"))
    found = dealt.join(many, same_keys(over, theirs) & (F.col("_turn") == F.col("_copy")))
    return found.select(*nodes.columns, "parent_conv_id")
