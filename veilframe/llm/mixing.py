"""Mix sources to target weights with hash-threshold histograms.

Every document has a fixed hash. A source's mix is its whole passes plus the
documents whose hash lies below a threshold; thresholds of growing budgets are
nested. A threshold is found digit by digit: sum tokens by source and hash
bucket, keep the buckets that fit, go on inside the one bucket that crosses the
budget. Nothing is sorted, and only one row per source decides.

Defined results: null text has size 0 and gives nothing; null sources are a
source of their own, last in order; an empty table gives an empty table;
repeated ids share a hash and, at the boundary, a fraction of their words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounded import broadcast_if_small
from .common import fresh, staged, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
REPEATS = 2
DIGITS, DIGIT_BITS = 6, 10


def row_hash(key: Column) -> Column:
    """60 bits of a document's id."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS
) -> DataFrame:
    """``source, source_size, target`` from ``source, size``: one row per source.

    Targets share the budget by weight; one that would pass ``repeats`` times its
    source stops there and the excess is shared again. That fixed point is
    ``min(cap, level * weight)``; ordered by cap / weight, the level is that of the
    first source which is not full. The windows run over the source catalogue
    (one row per source), never over documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    cap = (repeats * F.col("source_size")).cast("double")
    caps = totals.withColumn("weight", weight).withColumn("cap", cap)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy(F.lit(0))
    level = (
        F.sum("source_size").over(everyone) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(rest)
    levels = caps.withColumn("level", level)
    open_level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everyone)
    target = F.least("cap", F.coalesce(open_level * F.col("weight"), F.col("cap")))
    return levels.withColumn("target", target).select("source", "source_size", "target")


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source ``passes, bound, shift, rest, at_bound`` from ``source, size, h``.

    Documents whose hash bucket ``h >> shift`` lies below that of ``bound`` are
    taken once more; those in it share ``rest`` words out of their ``at_bound``.
    A bucket is refined until one row is left in it or one hash value.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.withColumn("passes", passes.cast("long"))
    rest = F.floor(F.col("target")).cast("long") - F.col("passes") * F.col("source_size")
    state = staged(
        state.select(
            "*",
            F.greatest(rest, F.lit(0)).cast("long").alias("rest"),
            F.lit(0).cast("long").alias("bound"),
            F.lit(DIGITS * DIGIT_BITS).alias("shift"),
            F.col("source_size").alias("at_bound"),
            F.lit(2).cast("long").alias("n"),
        )
    )
    for digit in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - digit)
        live = state.where((F.col("rest") > 0) & (F.col("n") > 1))
        if live.isEmpty():
            break
        edge = live.select(F.col("source").alias("_s"), F.col("bound").alias("_b"), F.col("rest").alias("_r"))
        inside = F.shiftright("h", shift + DIGIT_BITS) == F.shiftright("_b", shift + DIGIT_BITS)
        bins = (
            sizes.join(broadcast_if_small(edge), F.col("source").eqNullSafe(F.col("_s")))
            .where(inside)
            .groupBy("_s", "_r", F.shiftright("h", shift).alias("bin"))
            .agg(F.sum("size").alias("sum"), F.count("*").alias("rows"))
        )
        upto = F.sum("sum").over(Window.partitionBy("_s").orderBy("bin"))
        before = F.col("upto") - F.col("sum")
        found = (
            bins.withColumn("upto", upto)
            .where((before <= F.col("_r")) & (F.col("_r") < F.col("upto")))
            .select("_s", F.shiftleft("bin", shift).alias("_b"), (F.col("_r") - before).alias("_left"), "sum", "rows")
        )
        state = staged(
            state.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").select(
                "source",
                "source_size",
                "target",
                "passes",
                F.coalesce("_left", "rest").alias("rest"),
                F.coalesce("_b", "bound").alias("bound"),
                F.when(F.col("_b").isNull(), F.col("shift")).otherwise(shift).alias("shift"),
                F.coalesce("sum", "at_bound").alias("at_bound"),
                F.coalesce("rows", "n").alias("n"),
            )
        )
    return state


def taken_words(size: Column, h: Column, plan: dict[str, Column]) -> Column:
    """Words taken of a document, repeats counted, by its source's thresholds."""
    bucket, edge = F.call_function("shiftright", h, plan["shift"]), F.call_function("shiftright", plan["bound"], plan["shift"])
    wide = size.cast("decimal(18,0)") * plan["rest"].cast("decimal(18,0)")
    part = F.floor(wide / plan["at_bound"]).cast("long")
    more = F.when(plan["rest"] == 0, F.when(bucket < edge, size).otherwise(0)).when(bucket < edge, size)
    more = more.when((bucket == edge) & (plan["at_bound"] > 0), part).otherwise(0)
    return (plan["passes"] * size + F.coalesce(more, F.lit(0))).cast("long")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
) -> DataFrame:
    """All rows of ``docs`` with a struct column ``mix``: size, source_size, target, taken.

    Another name is chosen where ``mix`` exists. Sources are few beside documents;
    their thresholds are broadcast only when counted small, else joined by shuffle.
    """
    measured = docs.select(
        F.col(source).alias("source"), word_count(F.col(text)).alias("size"), row_hash(F.col(key)).alias("h")
    )
    sizes = staged(measured)
    state = thresholds(sizes, source_targets(sizes, weights, share, repeats))
    name, held, plan = (fresh(docs, n) for n in ("mix", "_measured", "_plan"))
    plans = broadcast_if_small(state.select(F.struct(*state.columns).alias(plan)))
    own = docs.withColumn(held, F.struct(word_count(F.col(text)).alias("size"), row_hash(F.col(key)).alias("h")))
    joined = own.join(plans, F.col(source).eqNullSafe(F.col(plan)["source"]))
    fields = {c: F.col(plan)[c] for c in state.columns}
    size, h = F.col(held)["size"], F.col(held)["h"]
    return joined.withColumn(
        name,
        F.struct(
            size.alias("size"),
            fields["source_size"].alias("source_size"),
            fields["target"].alias("target"),
            taken_words(size, h, fields).alias("taken"),
        ),
    ).drop(held, plan)


def mixed_rows(docs: DataFrame, **options: object) -> DataFrame:
    """The mix as rows: a document once per pass that takes words of it, whole texts.

    The one row at a boundary that only a fraction falls to stays once if at least
    half of its words are taken.
    """
    out = mix(docs, **options)
    name = next(c for c in reversed(out.columns) if c not in docs.columns)
    m = F.col(name)
    copies = F.when(m["size"] > 0, F.floor(m["taken"] / m["size"] + F.lit(0.5))).otherwise(0).cast("int")
    again = fresh(docs, "_copy")
    times = F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))
    return out.withColumn(again, F.explode(times)).select(*[F.col(f"`{c}`") for c in docs.columns])
