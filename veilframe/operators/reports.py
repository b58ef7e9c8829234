"""Readable reports and the choice of the best run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.format import fixed

# The entity types a report lists, in this order.
ENTITY_LABELS = [
    "BOD", "BUILDING", "CITY", "COUNTRY", "DATE", "DRIVERLICENSE", "EMAIL", "GEOCOORD",
    "GIVENNAME1", "GIVENNAME2", "IDCARD", "IP", "LASTNAME1", "LASTNAME2", "LASTNAME3", "PASS",
    "PASSPORT", "POSTCODE", "SECADDRESS", "SEX", "SOCIALNUMBER", "STATE", "STREET", "TEL",
    "TIME", "TITLE", "USERNAME",
]

# Looks of the report, in one place: a class per outcome.
HIT, WRONG, ALARM = "hit", "miss", "alarm"
STYLE = (
    "<style>.seq{line-height:1.9;font-family:serif}.seq b{border-bottom:3px solid;font-weight:normal}"
    ".hit{border-color:green}.miss{border-color:crimson}.alarm{border-color:orange}.seq small{opacity:.7}</style>"
)


def html_escape(text: Column) -> Column:
    out = text
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def _badge(text: Column, note: Column, outcome: str) -> Column:
    return F.concat(
        F.lit(f'<b class="{outcome}">'), html_escape(text), F.lit(" <small>"), html_escape(note), F.lit("</small></b>")
    )


def _marked(t: Column) -> Column:
    gold, pred = t["gold"], t["pred"]
    return (
        F.when((gold != "O") & (gold == pred), _badge(t["token"]["text"], gold, HIT))
        .when(gold != "O", _badge(t["token"]["text"], F.concat(gold, F.lit("→"), pred), WRONG))
        .when(pred != "O", _badge(t["token"]["text"], pred, ALARM))
        .otherwise(html_escape(t["token"]["text"]))
    )


def annotate_html(sequences: DataFrame, limit: int = 100) -> DataFrame:
    """Marked sequence for the first documents; ``tokens`` holds ``token, gold, pred``.

    Pick the documents before computing their tokens where those are not stored.
    """
    first = sequences.orderBy("doc_id").limit(limit)
    body = F.array_join(F.transform("tokens", _marked), "")
    frame = STYLE + '<div class="seq">'
    return first.select(
        "doc_id", F.concat(F.lit(frame), body, F.lit("</div>")).alias("annotated_sequence")
    )


def prediction_table(sequences: DataFrame, n: int = 50) -> DataFrame:
    """Tokens, gold and predicted tags joined by blanks, and the share of equal tags."""
    first = sequences.orderBy("doc_id").limit(n)
    right = F.size(F.filter("tokens", lambda t: t["gold"] == t["pred"]))
    percent = F.when(F.size("tokens") > 0, F.lit(100.0) * right / F.size("tokens"))

    return first.select(
        "doc_id",
        F.array_join("tokens.token.text", " ").alias("sequence"),
        F.array_join("tokens.gold", " ").alias("true_labels"),
        F.array_join("tokens.pred", " ").alias("pred_labels"),
        F.concat(fixed(percent, 2), F.lit("%")).alias("accuracy"),
    )


def entity_report(scores: DataFrame, worst: int | None = None) -> DataFrame:
    """One Markdown table as a single row; types without an F1 are left out.

    The label list is fixed, so the gathered lines are at most that many.
    """
    known = scores.where(F.col("label").isin(ENTITY_LABELS) & F.col("f1").isNotNull())
    if worst is None:
        place, kept = F.col("label"), known
    else:
        place, kept = F.struct("f1", "label"), known.orderBy("f1", "label").limit(worst)
    line = F.concat(
        F.lit("| "), "label", F.lit(" | "), fixed(F.col("f1"), 4), F.lit(" | "),
        F.coalesce(F.col("support").cast("string"), F.lit("None")), F.lit(" |\n"),
    )
    lines = F.array_sort(F.collect_list(F.struct(place.alias("place"), line.alias("line"))))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "")
    # Fixed value: the head of the table.
    header = "| Entity | F1 | Support |\n|--------|------|---------|\n"
    return kept.agg(F.concat(F.lit(header), body).alias("report"))


def best_log(logs: DataFrame) -> DataFrame:
    """Per run: newest checkpoint, its best step, and the first log there with an F1.

    ``logs`` holds ``run, checkpoint, best_step, pos, step, eval_f1`` and may hold
    ``best_checkpoint``. Two aggregations that combine before their shuffle; a
    run without a match keeps a null F1.
    """
    named = [c for c in ("best_step", "best_checkpoint") if c in logs.columns]
    hit = (F.col("step") == F.col("best_step")) & F.col("eval_f1").isNotNull()
    per_checkpoint = logs.groupBy("run", "checkpoint").agg(
        *[F.max(c).alias(c) for c in named],
        F.min(F.when(hit, F.struct("pos", "eval_f1"))).alias("log"),
    )
    newest = F.max(F.struct("checkpoint", *named, "log")).alias("n")
    return per_checkpoint.groupBy("run").agg(newest).select(
        "run",
        F.col("n.checkpoint").alias("checkpoint"),
        *[F.col(f"n.{c}").alias(c) for c in named],
        F.col("n.log.eval_f1").alias("eval_f1"),
    )


def first_checkpoint(logs: DataFrame) -> DataFrame:
    return logs.groupBy("run").agg(F.min("checkpoint").alias("checkpoint"))


def log_metrics(best: DataFrame) -> DataFrame:
    """Rows ``run, label, f1, support`` from the metric map of one log per run."""
    pairs = best.select("run", F.explode("metrics").alias("metric", "value"))
    named = pairs.select(
        "run",
        F.regexp_extract("metric", "^eval_(.+)_(f1|support)$", 1).alias("label"),
        F.regexp_extract("metric", "^eval_(.+)_(f1|support)$", 2).alias("kind"),
        "value",
    ).where(F.col("label") != "")
    return named.groupBy("run", "label").agg(
        F.max(F.when(F.col("kind") == "f1", F.col("value"))).alias("f1"),
        F.max(F.when(F.col("kind") == "support", F.col("value"))).cast("long").alias("support"),
    )


def best_metrics(logs: DataFrame) -> DataFrame:
    """Per run the metric map of the best log, for ``logs`` that carry ``metrics``.

    Each task keeps one map per run and checkpoint; no run's logs are gathered.
    """
    hit = (F.col("step") == F.col("best_step")) & F.col("eval_f1").isNotNull()
    place = F.when(hit, F.col("pos"))
    per_checkpoint = logs.groupBy("run", "checkpoint").agg(F.min_by("metrics", place).alias("metrics"), F.min(place).alias("pos"))
    newest = per_checkpoint.groupBy("run").agg(F.max_by(F.struct("metrics", "pos"), "checkpoint").alias("n"))
    return newest.where("n.pos IS NOT NULL").select("run", "n.metrics")


def compare_runs(registry: DataFrame, scores: DataFrame) -> DataFrame:
    """One Markdown row per registered model with its score."""
    row = F.format_string(
        "| [%s](%s) | %s | %s | %s | %s |",
        "model_name", "link", fixed(F.col("eval_f1"), 4), "size_label", "speed_label", "best_for",
    )
    return registry.join(scores.select("run", "eval_f1"), "run").select("run", row.alias("row"))
