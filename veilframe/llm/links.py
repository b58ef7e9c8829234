"""Linking without all pairs: groups as blocks, spanning forests, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged


def paired_blocks(rows: DataFrame, group: str, blocks: Column, member: str) -> DataFrame:
    """Deal the members of a group over its blocks and bring every two blocks together.

    ``blocks`` is the group's number of blocks. Rows are repeated once per other block
    and get ``i, j``; two members meet in at least one ``(group, i, j)``.
    """
    dealt = rows.withColumn("_n", blocks).withColumn("_b", F.pmod(F.xxhash64(member), F.col("_n")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda x: (x != F.col("_b")) | (F.col("_n") == 1))
    met = dealt.withColumn("_o", F.explode(others))
    return met.select(
        *rows.columns, F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j")
    )


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Frames of whole groups from batches sorted by ``keys``, with group starts and sizes.

    The last group of a batch is held over, as it may go on in the next.
    """
    held: list[pd.DataFrame] = []

    def cut(frame: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(frame), bool)
        change[0] = True
        for k in keys:
            v = frame[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not len(batch):
            continue
        starts = cut(batch)
        if held and not all(held[-1][k].iloc[-1] == batch[k].iloc[0] for k in keys):
            frame = pd.concat(held)
            yield frame, np.zeros(1, np.int64), np.array([len(frame)])
            held = []
        if len(starts) > 1:
            upto = int(starts[-1])
            if held:
                first = int(starts[1])
                frame = pd.concat([*held, batch.iloc[:first]])
                yield frame, np.zeros(1, np.int64), np.array([len(frame)])
                held = []
                if upto > first:
                    yield batch.iloc[first:upto], starts[1:-1] - first, np.diff(starts[1:])
            else:
                yield batch.iloc[:upto], starts[:-1], np.diff(starts)
            held.append(batch.iloc[upto:])
        else:
            held.append(batch)
    if held:
        frame = pd.concat(held)
        yield frame, np.zeros(1, np.int64), np.array([len(frame)])


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    n = len(linked)
    unseen = np.ones(n, bool)
    child, parent = [], []
    for root in range(n):
        if not unseen[root]:
            continue
        unseen[root] = False
        front = [root]
        while front:
            at = front.pop()
            new = np.flatnonzero(linked[at] & unseen)
            unseen[new] = False
            child += new.tolist()
            parent += [at] * len(new)
            front += new.tolist()
    return np.array(child, np.int64), np.array(parent, np.int64)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``edges (a, b)``, of any type that is ordered.

    The component is its least node.

    Rounds of contraction: every node points to its least neighbour or itself, pointers
    are followed twice, edges are drawn anew between the nodes pointed to. Edges at least
    halve their components per round; what is left is written to the shared folder.
    """
    clean = edges.select("a", "b").where("a <> b")
    now = staged(clean.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = now.select(F.col("a").alias("node")).unionByName(now.select(F.col("b").alias("node"))).distinct()
    found = staged(ends.select("node", F.col("node").alias("component")))
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        points = staged(least.select(F.col("a").alias("u"), F.least("a", "m").alias("p")))
        for _ in range(2):
            further = points.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
            jumped = points.join(further, points["p"] == F.col("_u")).select("u", F.col("_p").alias("p"))
            points = staged(jumped)
        found = staged(
            found.join(points, F.col("component") == F.col("u"), "left").select(
                "node", F.coalesce("p", "component").alias("component")
            )
        )
        left = points.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        right = points.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        drawn = now.join(left, "a").join(right, "b").where("pa <> pb")
        now = staged(drawn.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))
