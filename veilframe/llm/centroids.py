"""Sums over all subtrees of a forest by centroid decomposition.

A component's centroid is its deepest node with more than half of the component under
it; the nodes with more than half are just the path from there to the component's top.
What lies under the centroid is the centroid and the components that its children head
once it is cut out; their totals go to the centroid and to every other node of that path.
The components left, the children's and what lay above, have at most half the nodes
each and go on in the same way, until nothing is left: every node is in a logarithmic
number of components, however deep or wide the forest is.

Components of more than ``limit`` nodes are split by joins, where sizes and tops come
from pointers that double their reach; smaller ones are finished within a task, many at
a time, by the same steps on arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import broadcast_if_small
from .common import staged
from .links import whole_groups

LIMIT = 1 << 13
HOT = 10_000  # rows that may look up the same node in one task


def _labels(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes under each node, itself included, and its component's top; -1 has no parent."""
    n = len(parent)
    far, reach, size = np.where(parent < 0, np.arange(n), parent), parent, np.ones(n, np.int64)
    while (m := reach >= 0).any():
        more = np.zeros(n, np.int64)
        np.add.at(more, reach[m], size[m])
        size = size + more
        far = np.where(m, far[reach], far)
        reach = np.where(m, reach[reach], -1)
    return size, far


def subtree_sums(parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (n, k) over the subtrees of a forest; ``parent`` is -1 at tops."""
    n = len(parent)
    out = np.zeros_like(values)
    left, parent = np.arange(n), parent.copy()
    path = at = np.zeros(0, np.int64)  # nodes on the last round's paths, and their centroids
    origin = np.full(n, -1, np.int64)  # the centroid that a top was cut from
    while True:
        place = np.full(n, -1, np.int64)
        place[left] = np.arange(len(left))
        up = parent[left]
        size, top = _labels(np.where(up >= 0, place[up], -1))
        under = np.zeros_like(values)
        cut = origin[left[top]]
        np.add.at(under, cut[cut >= 0], values[left[cut >= 0]])  # totals of the components cut from a centroid
        out[path] += under[at] + values[at]
        if not len(left):
            return out
        wide = 2 * size > size[top]
        least = np.full(len(left), np.iinfo(np.int64).max)
        np.minimum.at(least, top[wide], size[wide])
        middle = wide & (size == least[top])
        of = np.zeros(len(left), np.int64)
        of[top[middle]] = left[middle]
        path, at = left[wide], of[top[wide]]
        origin[left] = -1
        gone = np.zeros(n, bool)
        gone[left[middle]] = True
        below = (up >= 0) & gone[up]
        origin[left[below]] = up[below]
        parent[left[below]] = -1
        left = left[~middle]


def _look_up(rows: DataFrame, key: str, table: DataFrame, node: str, hot: DataFrame) -> DataFrame:
    """``rows`` with the row of ``table`` for their key.

    ``hot`` (``_hot, _parts``) are the nodes that many rows ask for: they are repeated and
    those that ask are dealt over the copies. Which they are is sent to all tasks where
    that is little.
    """
    few = broadcast_if_small(hot)
    dealt = rows.join(few, F.col(key) == F.col("_hot"), "left")
    dealt = dealt.withColumn("_turn", F.coalesce(F.pmod(F.xxhash64("node"), F.col("_parts")), F.lit(0))).drop("_hot", "_parts")
    further = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_parts") - 1))
    more = table.join(few, F.col(node) == F.col("_hot")).select(*table.columns, further.alias("_copy"))
    many = table.withColumn("_copy", F.lit(0).cast("long")).unionByName(more)
    return dealt.join(many, (F.col(key) == F.col(node)) & (F.col("_turn") == F.col("_copy"))).drop("_turn", "_copy")


def _labelled(forest: DataFrame) -> DataFrame:
    """``node, size, top`` of ``node, parent``.

    A node's ``reach`` is its ancestor 1, 2, 4, ... steps up. Whoever has one adds what it
    has counted there, and takes over that ancestor's reach; nodes without one have found
    their top and take no further part.
    """
    found = [staged(forest.where("parent IS NULL").select("node", F.col("node").alias("top")))]
    one = F.lit(1).cast("long")
    now = staged(forest.where("parent IS NOT NULL").select("node", F.col("parent").alias("reach"), one.alias("size")))
    counted = [forest.select("node", one.alias("size"))]
    while not now.isEmpty():
        below = staged(now.groupBy(F.col("reach").alias("_node")).agg(F.sum("size").alias("_more"), F.count("*").alias("_uses")))
        counted.append(below.select(F.col("_node").alias("node"), F.col("_more").alias("size")))
        added = below.select(F.col("_node").alias("_own"), "_more")
        grown = now.join(added, F.col("node") == F.col("_own"), "left").select("node", "reach", (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"))
        nowhere = F.lit(None).cast(forest.schema["node"].dataType)
        table = now.select(F.col("node").alias("_node"), F.col("reach").alias("_reach"), nowhere.alias("_top"))
        for part in found:
            table = table.unionByName(part.select(F.col("node").alias("_node"), nowhere.alias("_reach"), F.col("top").alias("_top")))
        hot = below.where(F.col("_uses") > HOT).select(F.col("_node").alias("_hot"), F.ceil(F.col("_uses") / HOT).alias("_parts"))
        told = staged(_look_up(grown, "reach", table, "_node", hot).select("node", F.col("_reach").alias("reach"), F.col("_top").alias("top"), "size"))
        found.append(told.where("reach IS NULL").select("node", "top"))
        now = told.where("reach IS NOT NULL").drop("top")
    sizes = reduce(DataFrame.unionByName, counted).groupBy("node").agg(F.sum("size").alias("size"))
    return reduce(DataFrame.unionByName, found).join(sizes, "node")


def rollup(forest: DataFrame, values: list[str], limit: int = LIMIT) -> DataFrame:
    """``node`` and the sums of ``values`` (longs) over its subtree, itself included.

    ``forest`` has ``node, parent`` and the values, a node once; ``parent`` is null at
    tops. Nulls count as 0; an empty forest has an empty result.
    """
    sums = [F.sum(v).alias(v) for v in values]
    kept = forest.select("node", "parent", *[F.coalesce(F.col(v), F.lit(0)).cast("long").alias(v) for v in values])
    now = staged(kept.withColumn("origin", F.lit(None).cast(forest.schema["node"].dataType)))
    small, added = [], []
    path = None  # the last round's paths: node, centroid, and the centroid's own values
    while True:
        labels = _labelled(now)
        told = staged(now.join(labels, "node"))
        if path is not None:
            # A component's total goes to the centroid that its top was cut from.
            totals = told.groupBy("top").agg(*sums)
            heads = told.where("origin IS NOT NULL").select(F.col("node").alias("top"), "origin")
            under = heads.join(totals, "top").groupBy(F.col("origin").alias("centroid")).agg(*sums)
            middle = path.where("node = centroid").select("centroid", *values)
            whole = middle.unionByName(under.select("centroid", *values)).groupBy("centroid").agg(*sums)
            added.append(staged(path.select("node", "centroid").join(broadcast_if_small(whole), "centroid").select("node", *values)))
        big = told.where(f"node = top AND size > {limit}").select("top", F.col("size").alias("total"))
        big = staged(big)
        if big.isEmpty():
            small.append(told.select("node", "parent", "top", *values))
            break
        sized = staged(told.join(broadcast_if_small(big), "top", "left"))
        small.append(sized.where("total IS NULL").select("node", "parent", "top", *values))
        wide = sized.where("2 * size > total")
        middles = staged(wide.groupBy("top").agg(F.min_by("node", "size").alias("centroid")))
        path = staged(wide.join(broadcast_if_small(middles), "top").select("node", "centroid", *values))
        cut = broadcast_if_small(middles.select(F.col("centroid").alias("_cut")))
        rest = sized.where("total IS NOT NULL").drop("origin", "size", "top", "total").join(cut, F.col("node") == F.col("_cut"), "left_anti")
        rest = rest.join(cut, F.col("parent") == F.col("_cut"), "left")
        now = staged(rest.select("node", F.when(F.col("_cut").isNull(), F.col("parent")).alias("parent"), *values, F.col("_cut").alias("origin")))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, _, _ in whole_groups(batches, ["top"]):
            index = pd.Index(frame["node"])
            parents = frame["parent"]
            parent = np.where(parents.isna(), -1, index.get_indexer(parents))
            found = subtree_sums(parent, frame[values].to_numpy(np.int64))
            yield pd.DataFrame({"node": frame["node"], **{v: found[:, i] for i, v in enumerate(values)}})

    schema = f"node {forest.schema['node'].dataType.simpleString()}, " + ", ".join(f"{v} long" for v in values)
    rows = reduce(DataFrame.unionByName, small)
    done = rows.repartition("top").sortWithinPartitions("top").mapInPandas(finish, schema)
    return reduce(DataFrame.unionByName, [done, *added]).groupBy("node").agg(*sums)
