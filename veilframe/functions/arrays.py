"""Array helpers that stay linear in the array length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Adjacent projections are merged by the optimizer, which would copy an
    expensive expression into a lambda and run it once per element. A lambda
    argument is a value, so binding it this way is safe.
    """
    return F.transform(F.array(value), body)[0]


def blocks(arr: Column, size: int = BLOCK) -> Column:
    """Cut an array into consecutive arrays of at most ``size`` elements."""

    def cut(whole: Column) -> Column:
        last = F.floor((F.size(whole) - 1) / F.lit(size)).cast("int")
        return F.when(F.size(whole) == 0, F.array_repeat(whole, 0)).otherwise(
            F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(whole, b * size + 1, size))
        )

    return let(arr, cut)


def running_ends(lengths: Column) -> Column:
    """Running sum of an int array, usable inside lambdas.

    Appending to an array copies it, so the sum is carried over blocks: the
    copying is bounded by the block, not by the array.
    """

    def within(block: Column, base: Column) -> Column:
        sums = F.aggregate(
            block, F.array(base), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        )
        return F.slice(sums, 2, BLOCK)

    def over(block_list: Column) -> Column:
        return F.aggregate(
            block_list,
            F.array(F.array(F.lit(0))),
            lambda acc, b: F.concat(acc, F.array(within(b, F.element_at(F.element_at(acc, -1), -1)))),
        )

    def sums(ls: Column) -> Column:
        long = F.slice(F.flatten(over(blocks(ls))), F.lit(2), F.size(ls))
        return F.when(F.size(ls) <= BLOCK, within(ls, F.lit(0))).otherwise(long)

    return let(lengths, sums)


def explode_structs(df: DataFrame, keys: list, structs: Column) -> DataFrame:
    """One row per struct, its fields as columns; empty arrays give no row.

    The outer generator is used because the inner one adds a ``size(...) > 0``
    filter below itself, which evaluates the array expression a second time.
    """
    out = df.select(*keys, F.inline_outer(structs))
    first = out.columns[len(keys)]
    return out.where(F.col(first).isNotNull())
