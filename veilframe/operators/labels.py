"""Label statistics, vocabulary and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_counts(masks: DataFrame) -> DataFrame:
    """Counts per split and label, per split, and overall, in one aggregation."""
    return masks.rollup("split", "label").agg(F.count("*").alias("n"))


def total_label_counts(masks: DataFrame) -> DataFrame:
    return masks.groupBy("label").agg(F.count("*").alias("n"))


def least_common(counts: DataFrame, k: int = 5) -> DataFrame:
    return counts.orderBy("n", "label").limit(k)


def most_common(counts: DataFrame, k: int = 5) -> DataFrame:
    return counts.orderBy(F.desc("n"), "label").limit(k)


def build_vocab(masks: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """``label, label_id, entity, bio``: O is 0, the i-th entity to appear gets 1+2i and 2+2i.

    First appearance is an aggregate, so only one row per entity is ordered.
    """
    first = masks.groupBy("label").agg(F.min(F.struct(row_id, "mask_idx")).alias("seen"))
    ranked = first.select(
        F.col("label").alias("entity"),
        (F.row_number().over(Window.orderBy("seen")) - 1).alias("i"),
    )
    pair = F.array(
        F.struct(F.lit("B").alias("bio"), (F.lit(1) + 2 * F.col("i")).alias("label_id")),
        F.struct(F.lit("I").alias("bio"), (F.lit(2) + 2 * F.col("i")).alias("label_id")),
    )
    tags = ranked.select("entity", F.inline(pair)).select(
        F.concat_ws("-", "bio", "entity").alias("label"), "label_id", "entity", "bio"
    )
    outside = masks.sparkSession.createDataFrame(
        [("O", 0, None, "O")], "label string, label_id int, entity string, bio string"
    )
    return outside.unionByName(tags)


def id2label(vocab: DataFrame) -> DataFrame:
    return vocab.select("label_id", "label")


def entity_types(vocab: DataFrame) -> DataFrame:
    names = F.regexp_replace("label", "^[BI]-", "")
    return vocab.where(F.col("label") != "O").select(names.alias("entity")).distinct().orderBy("entity")


def split_half(df: DataFrame, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Exact halves by hash rank: ``half`` is ``validation`` or ``test``; test takes the odd row.

    Only the median is looked for, on hashes and keys: counts of 65,536 hash prefixes name
    the prefix it lies in, a rank inside that prefix the place. Rows are then compared with
    it where they are, so nothing of them moves. Rows that share a key stay together.
    """
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    narrow = df.select(hashed.alias("h"), F.substring(hashed, 1, 4).alias("p"), F.col(key).alias("k"))
    counts = narrow.groupBy("p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.floor(F.sum("n").over(Window.partitionBy()) / 2)
    placed = counts.select("p", "n", before.alias("before"), first.alias("first"))
    at = placed.where((F.col("before") < F.col("first")) & (F.col("first") <= F.col("before") + F.col("n")))
    cut = at.select(F.struct("p", (F.col("first") - F.col("before")).alias("r"))).scalar()
    inside = narrow.withColumn("cut", cut).where(F.col("p") == F.col("cut.p"))
    ranked = inside.withColumn("rn", F.row_number().over(Window.partitionBy("p").orderBy("h", "k")))
    median = ranked.where(F.col("rn") == F.col("cut.r")).select(F.struct("h", "k")).scalar()
    early = F.coalesce(F.struct(hashed.alias("h"), F.col(key).alias("k")) <= median, F.lit(False))
    return df.withColumn("half", F.when(early, "validation").otherwise("test"))


def split_half_by_parity(df: DataFrame, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Approximate halves from one hash bit: no shuffle at all."""
    digit = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 1)
    return df.withColumn("half", F.when(digit < "8", "validation").otherwise("test"))


def split_shares(df: DataFrame, column: str = "split") -> DataFrame:
    """Share of each split in percent, two decimals."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    share = F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 2)
    return counts.withColumn("percent", share)
