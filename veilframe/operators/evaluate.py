"""Precision, recall and F1 over spans, tokens and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_structs, let
from ..functions.tags import IGNORED, argmax, tag_spans
from .alignment import fresh, id_map

SPAN_KEY = ["doc_id", "label", "first", "last"]


def with_argmax(df: DataFrame, scores: str = "scores", alias: str = "pred_id") -> DataFrame:
    return df.withColumn(alias, argmax(F.col(scores)))


def decode_tags(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Drop positions whose gold id is -100 and turn ``gold_id``, ``pred_id`` into tags."""
    names = fresh(tokens, "_names")
    kept = tokens.where(F.col("gold_id") != IGNORED).withColumn(names, id_map(vocab, "label_id", "label"))
    for side in ("gold", "pred"):
        kept = kept.withColumn(side, F.try_element_at(F.col(names), F.col(f"{side}_id")))
    return kept.where(F.col("gold").isNotNull() & F.col("pred").isNotNull()).drop("gold_id", "pred_id", names)


def tags_to_spans(sequences: DataFrame, tags: str) -> DataFrame:
    """Rows ``doc_id, label, first, last`` from one array of kept tags per document."""
    return explode_structs(sequences, ["doc_id"], tag_spans(F.col(tags)))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 from ``tp, n_true, n_pred``; 0 on zero division."""
    p, r = F.col("precision"), F.col("recall")
    return (
        counts.withColumn("precision", ratio(F.col("tp"), F.col("n_pred")))
        .withColumn("recall", ratio(F.col("tp"), F.col("n_true")))
        .withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
    )


def stack_spans(true: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold and predicted spans under each other, marked ``t`` and ``p``."""
    return true.select(*SPAN_KEY, F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(
        pred.select(*SPAN_KEY, F.lit(0).alias("t"), F.lit(1).alias("p"))
    )


def stack_sequences(sequences: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """The same from rows that hold both arrays of tags, in one pass over them."""

    def marked(tags: str, t: int, p: int) -> Column:
        return F.transform(
            tag_spans(F.col(tags)),
            lambda s: F.struct(
                s["label"], s["first"], s["last"], F.lit(t).alias("t"), F.lit(p).alias("p")
            ),
        )

    return explode_structs(sequences, ["doc_id"], F.concat(marked(gold, 1, 0), marked(pred, 0, 1)))


def span_counts(stacked: DataFrame) -> DataFrame:
    """``label, tp, n_true, n_pred``; a match needs document, label and both ends.

    Both sides are reduced on the span itself, which combines before the shuffle
    and spreads even one hot label or document.
    """
    spans = stacked.groupBy(*SPAN_KEY).agg(F.max("t").alias("t"), F.max("p").alias("p"))
    return spans.groupBy("label").agg(
        F.sum(F.col("t") * F.col("p")).alias("tp"),
        F.sum("t").alias("n_true"),
        F.sum("p").alias("n_pred"),
    )


def entity_scores(stacked: DataFrame) -> DataFrame:
    """``label, precision, recall, f1, support`` per entity type."""
    rated = with_rates(span_counts(stacked))
    return rated.select("label", "precision", "recall", "f1", F.col("n_true").alias("support"))


def overall_scores(stacked: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 over all spans, and the mean F1 over types."""
    per_label = with_rates(span_counts(stacked))
    total = per_label.agg(
        F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("n_true"), F.lit(0)).alias("n_true"),
        F.coalesce(F.sum("n_pred"), F.lit(0)).alias("n_pred"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
    )
    return with_rates(total).select(
        "precision", "recall", F.col("f1").alias("micro_f1"), "macro_f1", F.col("n_true").alias("support")
    )


def right_tokens(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t["gold"] == t["pred"]))


def token_accuracy(sequences: DataFrame) -> DataFrame:
    """Share of right tokens over all; ``tokens`` holds ``gold, pred``. One partial sum."""
    tokens = F.col("tokens")
    every = F.sum(F.size(tokens))
    return sequences.agg(F.when(every > 0, F.sum(right_tokens(tokens)) / every).alias("accuracy"))


def doc_scores(sequences: DataFrame) -> DataFrame:
    """Token-level counts and rates of each row, rates rounded to four digits.

    Counted within the row; rows without a token that counts are left out.
    """

    def counted(tokens: Column) -> Column:
        def one(acc: Column, t: Column) -> Column:
            gold, pred = t["gold"], t["pred"]
            tests = {
                "tp": (gold != "O") & (gold == pred),
                "fp": (gold == "O") & (pred != "O"),
                "fn": (gold != "O") & (gold != pred),
            }
            return F.struct(*[(acc[n] + F.when(test, 1).otherwise(0)).alias(n) for n, test in tests.items()])

        # Most tokens are O on both sides; only the others are folded.
        said = F.filter(tokens, lambda t: (t["gold"] != "O") | (t["pred"] != "O"))
        zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in ("tp", "fp", "fn")])
        return F.when(F.size(tokens) > 0, F.array(F.aggregate(said, zero, one)))

    # A generator, not a filter, leaves rows out: a filter would be pushed below and count twice.
    counts = explode_structs(sequences, ["doc_id"], let(F.col("tokens"), counted))
    rated = with_rates(
        counts.withColumns({"n_pred": F.col("tp") + F.col("fp"), "n_true": F.col("tp") + F.col("fn")})
    )
    rounded = [F.round(c, 4).alias(c) for c in ("f1", "precision", "recall")]
    return rated.select("doc_id", *rounded, "tp", "fp", "fn")


def gathered(tokens: DataFrame) -> DataFrame:
    """Rows ``doc_id, tokens`` from one row per token, for token tables."""
    return tokens.groupBy("doc_id").agg(F.collect_list(F.struct("gold", "pred")).alias("tokens"))


def worst_labels(scores: DataFrame, k: int = 7) -> DataFrame:
    return scores.orderBy("f1", "label").limit(k)


def flat_metrics(stacked: DataFrame, sequences: DataFrame) -> DataFrame:
    """Rows ``metric, value``: overall rates, accuracy, and F1 and support per type."""

    def unpivoted(df: DataFrame, named: dict) -> DataFrame:
        pairs = [
            F.struct(metric.alias("metric"), F.col(value).cast("double").alias("value"))
            for value, metric in named.items()
        ]
        return df.select(F.inline(F.array(*pairs)))

    overall = {"precision": "precision", "recall": "recall", "micro_f1": "f1"}
    parts = unpivoted(overall_scores(stacked), {c: F.lit(name) for c, name in overall.items()})
    accuracy = unpivoted(token_accuracy(sequences), {"accuracy": F.lit("accuracy")})
    per_type = unpivoted(
        entity_scores(stacked),
        {c: F.concat("label", F.lit(f"_{c}")) for c in ("f1", "support")},
    )
    return parts.unionByName(accuracy).unionByName(per_type)
