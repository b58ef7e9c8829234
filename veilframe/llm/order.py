"""Places of rows in an order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, staged


def same_keys(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str, total: str | None = None, facts: DataFrame | None = None) -> DataFrame:
    """``rows`` with their place in their group, a long from 0; nulls come first.

    ``total`` names a column for the group's number of rows; ``facts`` has one row per
    group (the columns of ``group`` first) whose other columns are added.

    Rows are dealt by ranges of (group, order), so a group of any size lies over as many
    tasks as it needs; a task's rows are numbered as they come, and one row per task and
    group carries what came before, the total and the facts: no key of these joins is
    hotter than a task. Equal rows have neighbouring places. ``rows`` should be stored:
    ranges are found on a sample of them.
    """
    part, at, n, first, before = (fresh(rows, s) for s in ("_part", "_at", "_n", "_first", "_before"))
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the row's place in its task
    placed = staged(dealt.select("*", F.spark_partition_id().alias(part), place.alias(at)))
    heads = placed.groupBy(*group, part).agg(F.count("*").alias(n), F.min(at).alias(first))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0)) - F.col(first))
    more = [before]
    if total:
        heads = heads.withColumn(total, F.sum(n).over(whole))
        more.append(total)
    if facts is not None:
        added = facts.columns[len(group) :]
        told = facts.select(*[F.col(c).alias(f"_fact_{i}") for i, c in enumerate(group)], *added)
        heads = heads.join(told, same_keys(group, [f"_fact_{i}" for i in range(len(group))]))
        more += added
    theirs = heads.select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate(group)], F.col(part).alias("_of"), *more)
    same = (F.col(part) == F.col("_of")) & same_keys(group, [f"_of_{i}" for i in range(len(group))])
    return placed.join(theirs, same).select(*rows.columns, (F.col(at) + F.col(before)).alias(name), *more[1:])
