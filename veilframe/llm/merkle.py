"""Merkle manifest: a persistent tree over a table's rows, one version per edited row.

A row's leaf is the hash of its fields. Per group (source), every three neighbouring
nodes, in order of the key, become their hash until one is left, the group's subroot;
subroots, ordered by group, become the root in the same way.

The tree is stored in aligned blocks of 3^height nodes: a block's levels are built in one
task, its root is a node of the block above, and so on to the top, so a group of any size
is spread over blocks. Blocks are never changed. An edited row makes a version: a copy of
the ancestors of its leaf inside the block, all other nodes shared, and then a copy of
its block's ancestors in the blocks above. What a version needs from there, the siblings
along its block's way to the root, comes down block by block, one row per block.

Null fields are ``-`` in the hash; rows with a null group are a group (the first); null
keys come first; rows that share a key go in order of their leaves, and equal rows are
leaves of their own; empty and long texts are hashed whole; an empty table has an empty
result. Other columns take no part, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .links import whole_groups
from .order import numbered

ARITY, HEIGHT = 3, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TREE, GROUP = 0, 1  # the tree over the subroots, and those over leaves


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """``-`` for null, else the value's length in bytes, a colon, the value; hashed together."""

    def piece(value: Column) -> Column:
        shown = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))

    return F.sha2(F.concat(*map(piece, fields)).cast("binary"), 256)


def levels(nodes: list[str], whole: bool, height: int) -> list[list[str]]:
    """A block's nodes and the levels over them: ``height`` of them, or fewer where it is all of its tree."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= height:
        now = out[-1]
        out.append([digest(now[i : i + ARITY]) for i in range(0, len(now), ARITY)])
    return out


def siblings(tree: list[list[str]], at: int) -> list[tuple[int, list[str]]]:
    """Per level below the block's root: place among the run, and the run's others."""
    out = []
    for level in tree[:-1]:
        first = at - at % ARITY
        out.append((at - first, level[first:at] + level[at + 1 : first + ARITY]))
        at //= ARITY
    return out


def copies(leaf: str, way: list[tuple[int, list[str]]]) -> list[str]:
    """The ancestors that a version with this leaf copies, upwards."""
    out = []
    for k, others in way:
        leaf = digest([*others[:k], leaf, *others[k:]])
        out.append(leaf)
    return out


def to_text(way: list[tuple[int, list[str]]]) -> str:
    return ";".join(f"{k}," + ",".join(others) for k, others in way)


def from_text(way: str) -> list[tuple[int, list[str]]]:
    steps = [s.split(",") for s in way.split(";")] if way else []
    return [(int(k), [x for x in others if x]) for k, *others in steps]


NODE = "tree int, grp long, place long, n long, digest string"
KEYS = ["tree", "grp", "block"]


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """Nodes block by block, in order; a block's head, if it has one, first."""
    dealt = nodes.withColumn("block", F.floor(F.col("place") / F.lit(ARITY**height)))
    order = ["place"] if "head" not in nodes.columns else ["place", F.col("head").desc()]
    return dealt.repartition(*KEYS).sortWithinPartitions(*KEYS, *order)


def _above(nodes: DataFrame, height: int) -> DataFrame:
    """The roots of the blocks: the nodes of the blocks above."""
    size = ARITY**height

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts, sizes in whole_groups(batches, KEYS):
            nodes, n = frame["digest"].tolist(), frame["n"].to_numpy()
            tops = [levels(nodes[s : s + k], n[s] <= size, height)[-1][0] for s, k in zip(starts.tolist(), sizes.tolist(), strict=True)]
            heads = frame.iloc[starts]
            yield pd.DataFrame({"tree": heads["tree"], "grp": heads["grp"], "place": heads["block"], "n": -(-heads["n"] // size), "digest": tops})

    return _blocks(nodes, height).mapInPandas(build, NODE)


def _storeys(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes at the feet of every storey of blocks, up to the single node of each group."""
    out = [nodes]
    while not out[-1].where("n > 1").isEmpty():
        out.append(staged(_above(out[-1], height)))
    return out


WAY = "tree int, grp long, place long, way string"


def _ways(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """The siblings of every node on its way to the root, from those of its block's root."""
    size = ARITY**height

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts, sizes in whole_groups(batches, KEYS):
            digests, n, way = frame["digest"].tolist(), frame["n"].to_numpy(), frame["way"].tolist()
            out = []
            for s, k in zip(starts.tolist(), sizes.tolist(), strict=True):
                tree = levels(digests[s + 1 : s + k], n[s + 1] <= size, height)
                out += [to_text(siblings(tree, i) + from_text(way[s])) for i in range(k - 1)]
            keep = np.ones(len(frame), bool)
            keep[starts] = False
            yield frame.loc[keep, ["tree", "grp", "place"]].assign(way=out)

    return _blocks(_under(nodes, above, height), height).mapInPandas(walk, WAY)


def _under(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """Nodes, and before the first of each block a row with the way from its root upwards."""
    size = ARITY**height
    told = [c for c in ("way", "subroot") if c in above.columns]
    heads = above.select("tree", "grp", (F.col("place") * size).cast("long").alias("place"), *told)
    return nodes.withColumn("head", F.lit(False)).unionByName(heads.withColumn("head", F.lit(True)), allowMissingColumns=True)


class Manifest:
    """The tree over ``docs``, and the versions that edits make.

    ``edits`` gives columns as an edited row has them, ``edited`` which rows are edited
    (null counts as not). ``height`` is the levels of a block.
    """

    def __init__(self, docs: DataFrame, edits: dict[str, Column] | None = None, edited: Column | None = None, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", height: int = HEIGHT) -> None:
        self.height, self.key, self.group = height, key, group
        edits = edits or {}
        changed = F.coalesce(F.lit(False) if edited is None else edited, F.lit(False))
        was = [F.col(f"`{c}`") for c in fields]
        now = [edits.get(c, F.col(f"`{c}`")) for c in fields]
        rows = staged(docs.select(
            F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("name"),
            leaf_of(was).alias("leaf"), F.when(changed, leaf_of(now)).alias("edit"),
        ))
        groups = staged(numbered(staged(rows.select("name").distinct()), [], ["name"], "grp"))
        placed = numbered(rows, ["name"], ["key", "leaf", "edit"], "place", total="n", facts=groups)
        self.kind = rows.schema["key"].dataType
        # Keys travel as text: pandas would make numbers with nulls inexact.
        self.leaves = staged(placed.select(F.lit(GROUP).alias("tree"), "grp", "place", "n", F.col("key").cast("string").alias("key"), "leaf", "edit"))
        self.storeys = _storeys(self._nodes(), height)
        many = self.storeys[-1].count()  # one node each
        self.subroots = staged(self.storeys[-1].select(
            F.lit(TREE).alias("tree"), F.lit(0).cast("long").alias("grp"), F.col("grp").alias("place"),
            F.lit(many).cast("long").alias("n"), "digest",
        ))
        self.upper = _storeys(self.subroots, height)

    def _nodes(self) -> DataFrame:
        return self.leaves.select("tree", "grp", "place", "n", F.col("leaf").alias("digest"))

    def root(self) -> str | None:
        """The root's hash; none for an empty table."""
        top = self.upper[-1].first()
        return None if top is None else top["digest"]

    def _tops(self) -> DataFrame:
        """The single node of each group: its way to the root, and its hash as ``subroot``."""
        way = self.upper[-1].select("tree", "grp", "place", F.lit("").alias("way"))
        for nodes in reversed(self.upper[:-1]):
            way = staged(_ways(nodes, way, self.height))
        ways = way.select(F.col("place").alias("_grp"), "way")
        tops = self.storeys[-1].join(ways, F.col("grp") == F.col("_grp"))
        return staged(tops.select("tree", "grp", "place", "way", F.col("digest").alias("subroot")))

    def versions(self) -> DataFrame:
        """Per row ``key, leaf, edit, subroot, root, siblings, copied``.

        ``siblings`` are the others of each run on the way up, joined; ``copied`` the
        nodes that the row's version has of its own (for a row without an edit those that
        it would rewrite unchanged), the last of them the version's root, or the leaf
        itself where it has no ancestor.
        """
        above = self._tops()
        height = self.height if len(self.storeys) > 1 else 0  # without storeys every group is one leaf
        size = ARITY**height
        subroots = above.select(F.col("grp").alias("_grp"), "subroot")
        for nodes in reversed(self.storeys[1:-1]):
            way = _ways(nodes, above.drop("subroot"), height)
            above = staged(way.join(subroots, F.col("grp") == F.col("_grp")).drop("_grp"))

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame, starts, sizes in whole_groups(batches, KEYS):
                leaves, edits, n = frame["leaf"].tolist(), frame["edit"].tolist(), frame["n"].to_numpy()
                ways, tops = frame["way"].tolist(), frame["subroot"].tolist()
                subroots, others, copied = [], [], []
                for s, k in zip(starts.tolist(), sizes.tolist(), strict=True):
                    tree = levels(leaves[s + 1 : s + k], n[s + 1] <= size, height)
                    up = from_text(ways[s])
                    tail = "".join(x for _, xs in up for x in xs)
                    for i in range(k - 1):
                        within, own = siblings(tree, i), edits[s + 1 + i]
                        own = own if isinstance(own, str) else leaves[s + 1 + i]
                        mine = copies(own, within)
                        mine += copies(mine[-1] if mine else own, up)
                        copied.append(mine or [own])
                        others.append("".join(x for _, xs in within for x in xs) + tail)
                        subroots.append(tops[s])
                keep = np.ones(len(frame), bool)
                keep[starts] = False
                yield frame.loc[keep, ["key", "leaf", "edit"]].assign(subroot=subroots, siblings=others, copied=copied)

        dealt = _blocks(_under(self.leaves, above, height), height)
        out = dealt.mapInPandas(fold, "key string, leaf string, edit string, subroot string, siblings string, copied array<string>")
        return out.withColumn("key", F.col("key").cast(self.kind)).withColumn("root", F.lit(self.root()).cast("string"))

    def nodes(self) -> DataFrame:
        """The stored nodes at the feet of all storeys: ``tree, storey, grp, place, n, digest``."""
        out = None
        for storeys in (self.storeys, self.upper):
            for i, nodes in enumerate(storeys):
                some = nodes.withColumn("storey", F.lit(i))
                out = some if out is None else out.unionByName(some)
        return out


def proofs(manifest: Manifest) -> DataFrame:
    """Per row its leaf, subroot and root, the hash of its siblings, and what its version folds to."""
    rows = manifest.versions()
    folded = F.element_at("copied", -1)
    return rows.select(
        F.col("key").alias(manifest.key), "leaf", "subroot", "root",
        F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"),
    )
