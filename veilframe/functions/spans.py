"""Arrays of spans: shape and overlap resolution inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import blocks, let

# Sorting by the natural struct order is the order in which overlaps are read.
SPAN = "struct<start:int,end:int,chunk_id:int,pos:int,label:string,score:double>"
SPANS = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def resolve_array(spans: Column) -> Column:
    """Keep the best span of every overlapping group, in order of position.

    Read in sorted order, a span that starts at or after the widest end so far
    opens a new group; on equal scores the earlier span stays.
    """
    out = F.lit(None).cast(SPAN)

    def one(acc: Column, s: Column) -> Column:
        opens = s["start"] >= acc["reach"]
        closed = F.when(opens & acc["best"].isNotNull(), F.concat(acc["out"], F.array(acc["best"])))
        return F.struct(
            F.when(opens | (s["score"] > acc["best"]["score"]), s).otherwise(acc["best"]).alias("best"),
            F.greatest(acc["reach"], s["end"]).alias("reach"),
            closed.otherwise(acc["out"]).alias("out"),
        )

    def block(acc: Column, b: Column) -> Column:
        zero = F.struct(acc["best"].alias("best"), acc["reach"].alias("reach"), no_spans().alias("out"))
        return let(
            F.aggregate(b, zero, one),
            lambda r: F.struct(
                r["best"].alias("best"),
                r["reach"].alias("reach"),
                F.concat(acc["out"], F.array(r["out"])).alias("out"),
            ),
        )

    zero = F.struct(
        out.alias("best"), F.lit(0).alias("reach"), F.array().cast(f"array<{SPANS}>").alias("out")
    )
    return F.when(F.size(spans) <= 1, spans).otherwise(
        F.aggregate(
            blocks(F.array_sort(spans)),
            zero,
            block,
            lambda acc: F.concat(F.flatten(acc["out"]), F.array(acc["best"])),
        )
    )
