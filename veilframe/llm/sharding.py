"""K-d tree sharding: split at weighted medians along the widest metadata dimension.

A node of k shards is cut where the bytes on its left come nearest to the share
of floor(k / 2) shards. Medians come from histograms: sum bytes by node and bin,
find the bin that crosses, go on inside it. The driver holds the tree (one entry
per shard) and at most nodes x 1,024 bin sums, whatever the table's size.

Dimensions are functions of the text, so equal texts always share a shard; ties
on a dimension are split by the text's hash. A group of equal texts is never cut,
so one that outweighs a shard makes that shard heavy. Null text weighs 8 bytes, as
empty text does, and goes with it. No rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

COORD_BITS, HASH_BITS, BIN_BITS = 30, 30, 10
OVERHEAD = 8
SLOT_GROUP = 2_000
# A median is close enough when this share of one shard's bytes is left undecided.
TOLERANCE = 0.0005


@dataclass
class Node:
    """Shards ``first`` to ``first + shards - 1``; a cut sends smaller keys left."""

    first: int
    shards: int
    axis: int = -1
    cut: int = 0
    low: Node | None = None
    high: Node | None = None
    state: dict = field(default_factory=dict)


def metadata(text: Column) -> list[Column]:
    """Widths are comparable: each coordinate is scaled to 30 bits of its own range."""
    size, chars = F.octet_length(text), F.length(text)
    one = F.lit(float(1 << COORD_BITS) - 1)
    lines = F.regexp_count(text, F.lit("\n")) + 1
    log_size = F.log2(size + 1) / 32
    wide = (size - chars) / F.greatest(size, F.lit(1))
    log_lines = F.log2(lines + F.lit(1)) / 32
    return [F.floor(c * one).cast("long") for c in (log_size, wide, log_lines)]


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document: what the tree and the slots need, no text."""
    t = F.coalesce(F.col(text), F.lit(""))
    digest = F.shiftrightunsigned(F.xxhash64(t), 64 - HASH_BITS)
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(t) + OVERHEAD).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.array(*metadata(t)).alias("at"),
        digest.alias("tie"),
        F.monotonically_increasing_id().alias("place"),
    )


def _key(axis: int) -> Column:
    return F.shiftleft(F.col("at")[axis], HASH_BITS).bitwiseOR(F.col("tie"))


def _route(node: Node, leaf) -> Column:
    """Nested conditions of the tree; ``leaf`` says what a node without a cut gives."""
    if node.low is None:
        return leaf(node)
    return F.when(_key(node.axis) < node.cut, _route(node.low, leaf)).otherwise(_route(node.high, leaf))


def grow(rows: DataFrame, shards: int) -> Node:
    """The tree over staged ``rows``; each level is decided for all its nodes at once."""
    root = Node(0, shards)
    open_nodes = [root] if shards > 1 else []
    axes = range(len(rows.first()["at"]) if open_nodes and not rows.isEmpty() else 0)
    while open_nodes and axes:
        index = {id(n): i for i, n in enumerate(open_nodes)}

        def numbered(value) -> Column:
            return _route(root, lambda n: value(n) if id(n) in index else F.lit(None))

        member = numbered(lambda n: F.lit(index[id(n)]))
        bounds = [f(_key(a)).alias(f"{f.__name__}{a}") for a in axes for f in (F.min, F.max)]
        found = {
            r["node"]: r
            for r in rows.groupBy(member.alias("node")).agg(F.sum("size").alias("w"), *bounds).collect()
            if r["node"] is not None
        }
        for n in open_nodes:
            r = found.get(index[id(n)])
            if r is None:  # no rows reach this node
                n.state = {"axis": 0, "lo": 0, "shift": 0, "done": True, "cut": 0}
                continue
            width = [(r[f"max{a}"] >> HASH_BITS) - (r[f"min{a}"] >> HASH_BITS) for a in axes]
            axis = max(axes, key=lambda a: (width[a], -a))
            lo, hi = r[f"min{axis}"], r[f"max{axis}"]
            want = r["w"] * (n.shards // 2) / n.shards
            shift = max(0, (hi - lo).bit_length() - BIN_BITS)
            n.state = {"axis": axis, "lo": lo, "shift": shift, "left": 0, "want": want, "done": False}
            n.state |= {"slack": TOLERANCE * r["w"] / n.shards, "cut": lo}
        _medians(rows, root, open_nodes, index)
        grown = []
        for n in open_nodes:
            half = n.shards // 2
            n.axis, n.cut = n.state["axis"], n.state["cut"]
            n.low, n.high = Node(n.first, half), Node(n.first + half, n.shards - half)
            grown += [c for c in (n.low, n.high) if c.shards > 1]
        open_nodes = grown
    return root


def _medians(rows: DataFrame, root: Node, nodes: list[Node], index: dict[int, int]) -> None:
    """Refine each node's crossing bin until little enough is left in it."""
    while live := [n for n in nodes if not n.state["done"]]:
        alive = {id(n) for n in live}

        def of(value) -> Column:
            return _route(root, lambda n: value(n) if id(n) in alive else F.lit(None))

        offset = of(lambda n: _key(n.state["axis"]) - F.lit(n.state["lo"]))
        bin_ = of(lambda n: F.shiftright(_key(n.state["axis"]) - F.lit(n.state["lo"]), n.state["shift"]))
        member = of(lambda n: F.lit(index[id(n)]))
        bins = (
            rows.select(member.alias("node"), bin_.alias("bin"), offset.alias("offset"), "size")
            .where((F.col("offset") >= 0) & (F.col("bin") < 1 << BIN_BITS))
            .groupBy("node", "bin")
            .agg(F.sum("size").alias("w"))
            .collect()
        )
        by_node: dict[int, list] = {}
        for r in bins:
            by_node.setdefault(r["node"], []).append((r["bin"], r["w"]))
        for n in live:
            s = n.state
            for b, w in sorted(by_node.get(index[id(n)], [])):
                if s["left"] + w >= s["want"]:
                    break
                s["left"] += w
            else:
                s["done"] = True
                continue
            start, step = s["lo"] + (b << s["shift"]), 1 << s["shift"]
            if s["shift"] == 0 or w <= s["slack"]:
                before, after = s["want"] - s["left"], s["left"] + w - s["want"]
                s |= {"done": True, "cut": start if before < after else start + step}
            else:
                s |= {"lo": start, "cut": start, "shift": max(0, s["shift"] - BIN_BITS)}


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int = 1 << 30, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row per document.

    Without ``shards`` as many leaves are made as ``target_bytes`` asks for. Slots
    are counted in groups of rows spread by their place in the staged table, so no
    window holds a whole shard and a repeated id does no harm.
    """
    rows = staged(measure(docs, key, text))
    if shards is None:
        total = rows.agg(F.sum("size").alias("w")).first()["w"] or 0
        shards = max(1, -(-total // target_bytes))
    tree = grow(rows, shards)
    groups = max(1, rows.count() // (shards * SLOT_GROUP))
    put = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        "place",
        _route(tree, lambda n: F.lit(n.first)).cast("int").alias("shard"),
        F.pmod(F.xxhash64("place"), F.lit(groups)).alias("part"),
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = put.groupBy("shard", "part").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "part").orderBy("place")
    ranked = put.withColumn("nth", F.row_number().over(within))
    return ranked.join(offsets, ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("nth") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
