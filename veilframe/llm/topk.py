"""Exact inner-product search: norm-sorted blocks, rotated partial sums, residual bounds.

Candidates are sorted by descending length and packed into blocks, which are dealt
over lanes; a task takes all queries it can hold down one lane, longest vectors first,
with each query's k-th score so far as its bar. A block is left out where length
times length stays below the bar; else the first coordinates in the basis of the
corpus' singular vectors give partial sums, the Cauchy-Schwarz bound of the rest is
added, and only pairs that reach the bar are scored, in exact integers.

Components are ``floor(scale * x)``. Rows without an id, and vectors that are null
or hold null or non-finite components, take no part; vectors meet those of their own
dimension only, and empty ones score 0. Rows that share an id stay rows of their
own, each answered with every row but itself. Fewer candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounded import broadcast_if_small
from .common import shuffle_width, staged

CANDIDATES, QUERIES = 2048, 512
HELD = 32 << 20  # bytes of queries that a task holds, their rotated forms included
STAGES = (8, 16, 32)
EXACT = float(1 << 52)
SLACK = 1e-9
VECTORS = "id long, place long, dim int, norm double, data binary"
BLOCKS = "dim int, block long, norm double, ids binary, places binary, data binary"
FOUND = "query_id long, query_place long, vec_id long, place long, score long"


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def _integers(rows: DataFrame, scale: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.floor(scale * np.asarray(v, np.float64)) for v in batch["v"]]
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "place": batch["place"],
                    "dim": [len(v) for v in found],
                    "norm": [float(np.sqrt(v @ v)) for v in found],
                    "data": [v.tobytes() for v in found],
                }
            )

    return rows.mapInPandas(run, VECTORS)


def _matrix(data: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), dim)


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Right singular vectors per dimension, from the sum of outer products.

    The driver gets dim x dim sums for each dimension that occurs, however many rows.
    """

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                if dim:
                    x = _matrix(part["data"], dim)
                    x = x / max(1.0, float(np.abs(x).max()))
                    yield pd.DataFrame({"dim": dim, "cell": np.arange(dim * dim), "v": (x.T @ x).ravel()})

    sums = vectors.select("dim", "data").mapInPandas(outer, "dim int, cell int, v double")
    cells = sums.groupBy("dim", "cell").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for dim, part in cells.groupby("dim"):
        moment = part.sort_values("cell")["v"].to_numpy().reshape(dim, dim)
        out[int(dim)] = np.linalg.eigh((moment + moment.T) / 2)[1][:, ::-1].copy()
    return out


def _blocks(vectors: DataFrame, most: int) -> DataFrame:
    """Vectors by dimension and falling length, ``most`` to a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for dim, part in batch.groupby("dim", sort=False):
                for a in range(0, len(part), most):
                    some = part.iloc[a : a + most]
                    yield pd.DataFrame(
                        {
                            "dim": [dim],
                            "block": [number],
                            "norm": [some["norm"].max()],
                            "ids": [some["id"].to_numpy(np.int64).tobytes()],
                            "places": [some["place"].to_numpy(np.int64).tobytes()],
                            "data": [b"".join(some["data"])],
                        }
                    )
                    number += 1

    order = [F.col("dim"), F.col("norm").desc(), F.col("id"), F.col("place")]
    ranged = vectors.repartitionByRange(shuffle_width(vectors.sparkSession), *order)
    return ranged.sortWithinPartitions(*order).mapInPandas(run, BLOCKS)


class _Search:
    """One block of queries on its way down a lane."""

    def __init__(self, row: pd.Series, k: int, basis: np.ndarray | None) -> None:
        self.dim, self.k, self.basis = int(row["dim"]), k, basis
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.places = np.frombuffer(row["places"], np.int64)
        self.x = np.frombuffer(row["data"], np.float64).reshape(len(self.ids), self.dim)
        self.norms = np.sqrt((self.x * self.x).sum(1))
        self.turned = self.x @ basis if basis is not None else self.x
        self.bar = np.full(len(self.ids), -np.inf)
        none = np.zeros(0, np.int64)
        self.best = (none, none, none, none)  # query, score, id, place

    def _scores(self, c: np.ndarray, q: np.ndarray, j: np.ndarray) -> np.ndarray:
        if not self.dim:
            return np.zeros(len(q), np.int64)
        reach = float(self.norms.max(initial=0)) * float(np.sqrt((c * c).sum(1)).max(initial=0))
        if reach < EXACT:
            out = np.empty(len(q), np.int64)
            for a in range(0, len(q), 1 << 16):
                out[a : a + (1 << 16)] = np.einsum("ij,ij->i", self.x[q[a : a + (1 << 16)]], c[j[a : a + (1 << 16)]])
            return out
        low, high = -(1 << 63), (1 << 63) - 1  # beyond a long the score stops there
        wide = [sum(int(a) * int(b) for a, b in zip(self.x[s], c[t], strict=True)) for s, t in zip(q, j, strict=True)]
        return np.array([min(max(w, low), high) for w in wide], np.int64)

    def meet(self, row: pd.Series) -> None:
        active = np.flatnonzero(self.norms * row["norm"] * (1 + SLACK) + SLACK >= self.bar)
        if not len(active):
            return
        ids, places = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["places"], np.int64)
        c = np.frombuffer(row["data"], np.float64).reshape(len(ids), self.dim)
        turned = c @ self.basis if self.basis is not None else c
        mine = self.turned[active]
        sums, done = np.zeros((len(active), len(ids))), 0
        size = np.outer(self.norms[active], np.sqrt((c * c).sum(1)))
        live = np.ones(sums.shape, bool)
        for upto in (*(s for s in STAGES if s < self.dim),):
            sums += mine[:, done:upto] @ turned[:, done:upto].T
            done = upto
            rest = np.outer(np.sqrt((mine[:, upto:] ** 2).sum(1)), np.sqrt((turned[:, upto:] ** 2).sum(1)))
            live = sums + rest + SLACK * (1 + size) >= self.bar[active][:, None]
            if live.sum() * 4 < live.size:
                break
        q, j = np.nonzero(live)
        q = active[q]
        other = self.places[q] != places[j]
        q, j = q[other], j[other]
        self._keep(q, self._scores(c, q, j), ids[j], places[j])

    def _keep(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        q, score, ids, places = (np.concatenate(x) for x in zip(self.best, (q, score, ids, places), strict=True))
        order = np.lexsort((places, ids, -score.astype(np.float64), q))
        # Doubles order large scores only roughly; the stable second pass is on exact values.
        if len(score) and np.abs(score.astype(np.float64)).max() >= EXACT:
            order = np.array(sorted(range(len(q)), key=lambda i: (q[i], -int(score[i]), ids[i], places[i])), np.int64)
        q = q[order]
        first = np.searchsorted(q, q)
        nth = np.arange(len(q)) - first
        top = order[nth < self.k]
        q = q[nth < self.k]
        self.best = (q, score[top], ids[top], places[top])
        last = np.flatnonzero(nth[nth < self.k] == self.k - 1)
        self.bar[q[last]] = self.best[1][last].astype(np.float64)

    def found(self) -> pd.DataFrame:
        q, score, ids, places = self.best
        return pd.DataFrame({"query_id": self.ids[q], "query_place": self.places[q], "vec_id": ids, "place": places, "score": score})


def search(
    vectors: DataFrame, wanted: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``wanted`` holds, against all."""
    rows = vectors.where(F.col(key).isNotNull() & _usable(F.col(vector))).select(
        F.col(key).cast("long").alias("id"),
        F.monotonically_increasing_id().alias("place"),
        F.col(vector).cast("array<double>").alias("v"),
        wanted.alias("wanted"),
    )
    rows = staged(rows)
    every = staged(_integers(rows.drop("wanted"), scale))
    asked = _integers(rows.where("wanted").drop("wanted"), scale)
    bases = rotations(every)
    there = staged(_blocks(every, CANDIDATES))
    asking = staged(_blocks(asked, QUERIES))

    # As many query blocks go down a lane together as a task may hold: a candidate is read once
    # for all of them. Queries are copied to every lane, so there are no more lanes than tasks.
    counts = asking.groupBy("dim").agg(F.count("*").alias("n"))
    teams = F.ceil(F.col("n") * QUERIES * 16 * F.greatest("dim", F.lit(1)) / HELD).cast("int")
    teams = broadcast_if_small(counts.select("dim", teams.alias("teams")))
    most = teams.agg(F.max("teams")).first()[0] or 1
    lanes = -(-max(1, shuffle_width(vectors.sparkSession)) // most)
    asking = asking.join(teams, "dim").withColumn("team", F.pmod(F.xxhash64("block"), F.col("teams")).cast("int"))
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")
    facts = ["dim", "norm", "ids", "places", "data"]
    down = there.join(teams, "dim").select(F.explode(F.sequence(F.lit(0), F.col("teams") - 1)).alias("team"), lane.alias("lane"), F.lit(1).alias("kind"), *facts)
    starts = asking.select("team", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("kind"), *facts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, team = None, []
        for batch in batches:
            for _, row in batch.iterrows():
                if (now := (row["dim"], row["team"], row["lane"])) != key:
                    yield from (one.found() for one in team)
                    key, team = now, []
                if row["kind"] == 0:
                    team.append(_Search(row, k, bases.get(int(row["dim"]))))
                else:
                    for one in team:
                        one.meet(row)
        yield from (one.found() for one in team)

    by = ["dim", "team", "lane"]
    dealt = starts.unionByName(down).repartition(shuffle_width(vectors.sparkSession), *by)
    dealt = dealt.sortWithinPartitions(*by, "kind", F.col("norm").desc())
    best = Window.partitionBy("query_id", "query_place").orderBy(F.col("score").desc(), "vec_id", "place")
    ranked = dealt.mapInPandas(run, FOUND).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
