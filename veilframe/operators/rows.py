"""Row-level preparation of a labelled corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_structs
from ..functions.bounded import broadcast_if_small


def filter_language(corpus: DataFrame, language: str = "English") -> DataFrame:
    return corpus.where(F.col("language") == language)


def keep_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def mask_rows(corpus: DataFrame, *keys: str, masks: str = "privacy_mask") -> DataFrame:
    """One row per mask: the keys, ``mask_idx, start, end, label``."""
    numbered = F.transform(
        masks,
        lambda m, i: F.struct(i.alias("mask_idx"), m["start"], m["end"], m["label"]),
    )
    return explode_structs(corpus, list(keys), numbered)


def rare_labels(masks: DataFrame, min_count: int = 50) -> DataFrame:
    """Labels of the given (train) masks with a count strictly below ``min_count``."""
    return masks.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") < min_count)


def drop_labels(corpus: DataFrame, rare: DataFrame) -> DataFrame:
    """Remove masks with a rare label from every row; the row and its other masks stay.

    The labels come as one array from a scalar subquery, so nothing is joined, no row is
    regrouped and no job runs while the plan is built. A mask without a label stays
    unless the rare labels hold a null themselves.
    """
    name = "_rare" if "_rare" not in corpus.columns else "__rare"
    listed = rare.agg(
        F.struct(
            F.collect_set("label").alias("names"),
            F.coalesce(F.bool_or(F.col("label").isNull()), F.lit(False)).alias("none"),
        )
    )
    held = corpus.withColumn(name, listed.scalar())

    def goes(m: Column) -> Column:
        named = F.array_contains(F.col(name)["names"], m["label"])
        return F.when(m["label"].isNull(), F.col(name)["none"]).otherwise(named)

    return held.withColumn("privacy_mask", F.filter("privacy_mask", lambda m: ~goes(m))).drop(name)


def count_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many masks went missing between two states of a corpus."""
    sizes = before.select(F.size("privacy_mask").cast("long").alias("n")).unionByName(
        after.select((-F.size("privacy_mask")).cast("long").alias("n"))
    )
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("removed"))


def labels_left(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Masks per removed label that are still present; no rows when all are gone."""
    named = broadcast_if_small(labels.select(F.col("label").alias("_label")).distinct())
    left = masks.join(named, F.col("label").eqNullSafe(F.col("_label")), "left_semi")
    return left.groupBy("label").agg(F.count("*").alias("n"))


def assert_absent(masks: DataFrame, labels: DataFrame) -> None:
    if not labels_left(masks, labels).isEmpty():
        raise AssertionError("removed labels are still present")


def split_by_metric(metrics: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Metrics below the threshold are ``missed``, others ``passed`` unless a support.

    A support count below the threshold is missed as well.
    """
    outcome = F.when(F.col("value") < threshold, "missed").when(
        ~F.endswith("metric", F.lit("support")), "passed"
    )
    return metrics.withColumn("outcome", outcome).where(F.col("outcome").isNotNull())
