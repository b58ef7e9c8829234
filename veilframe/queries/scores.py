"""Evaluation, reports and run selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import explode_structs
from ..functions.bounded import broadcast_if_small
from ..functions.format import exact_mean, fixed
from ..operators import evaluate as ev
from ..operators import reports as rep
from ..operators.alignment import encode_labels
from ..operators.labels import build_vocab
from ..operators.rows import mask_rows, split_by_metric
from ..plans.evaluation import kept_sequences, tag_columns, tagged_pairs
from ..plans.silver import scored_corpus
from ..session import shared_dir
from ..sources.run_logs import read_run_logs, write_run_logs
from ..sources.tables import table
from . import REGISTRY, sql

add = REGISTRY.add


def sequences(spark, sf, first=None):
    """Of all documents, or of the ``first`` by id, which are picked before anything is computed."""
    return kept_sequences(tagged_pairs(scored_corpus(spark, sf, first)))


def stacked(spark, sf):
    """Gold and predicted spans from one pass over the texts."""
    return ev.stack_sequences(tag_columns(sequences(spark, sf)))


@add(
    "g1_argmax",
    """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS best FROM embeddings""",
)
def g1(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return ev.with_argmax(vectors, "embedding", "best").select("vec_id", "best")


@add(
    "g2_decode_tags",
    sql.with_(*sql.PAIR_MEMBERS, body="SELECT doc_id, token_idx, gold, pred FROM kept"),
)
def g2(spark, sf):
    """Tags to ids of the shared vocabulary, then back through the decoder."""
    rows = scored_corpus(spark, sf)
    both = mask_rows(rows, "doc_id").unionByName(mask_rows(rows, "doc_id", masks="predicted_mask"))
    vocab = broadcast_if_small(build_vocab(both))
    pairs = explode_structs(tagged_pairs(rows), ["doc_id"], F.col("tokens"))
    tokens = pairs.select("doc_id", "token.*", "gold", "pred")
    gold = encode_labels(tokens.withColumnRenamed("gold", "tag"), vocab).withColumnRenamed("label_id", "gold_id")
    pred = encode_labels(
        gold.drop("tag").withColumnRenamed("pred", "tag").withColumn("start", F.col("word_start")), vocab
    ).withColumnRenamed("label_id", "pred_id")
    return ev.decode_tags(pred.select("doc_id", "token_idx", "gold_id", "pred_id"), vocab)


@add(
    "g3_tags_to_spans",
    sql.with_(*sql.SPAN_MEMBERS, body='SELECT doc_id, label, "first", "last" FROM pspans'),
)
def g3(spark, sf):
    return ev.tags_to_spans(tag_columns(sequences(spark, sf)), "pred")


_ROUND = 'round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1'


@add(
    "g4_entity_scores",
    sql.with_(*sql.SCORE_MEMBERS, body=f"SELECT label, {_ROUND}, n_true AS support FROM rates"),
)
def g4(spark, sf):
    return rounded(ev.entity_scores(stacked(spark, sf)), "precision", "recall", "f1")


@add(
    "g4_entity_scores_of_tables",
    sql.with_(*sql.SCORE_MEMBERS, body=f"SELECT label, {_ROUND}, n_true AS support FROM rates"),
)
def g4_tables(spark, sf):
    """The same from two stored tables of spans."""
    tags = tag_columns(sequences(spark, sf))
    both = ev.stack_spans(ev.tags_to_spans(tags, "gold"), ev.tags_to_spans(tags, "pred"))
    return rounded(ev.entity_scores(both), "precision", "recall", "f1")


def rounded(df, *names):
    return df.withColumns({name: F.round(name, 6) for name in names})


@add(
    "g5_overall_scores",
    sql.with_(
        *sql.SCORE_MEMBERS,
        body="""SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS micro_f1,
                  round(macro, 6) AS macro_f1, support
                FROM (SELECT sum(tp) / sum(n_pred) AS p, sum(tp) / sum(n_true) AS r, avg(f1) AS macro,
                        CAST(sum(n_true) AS BIGINT) AS support FROM rates)""",
    ),
)
def g5(spark, sf):
    return rounded(
        ev.overall_scores(stacked(spark, sf)), "precision", "recall", "micro_f1", "macro_f1"
    )


@add(
    "g6_token_accuracy",
    sql.with_(
        *sql.PAIR_MEMBERS,
        body="SELECT round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM kept",
    ),
)
def g6(spark, sf):
    return ev.token_accuracy(sequences(spark, sf)).select(F.round("accuracy", 9).alias("accuracy"))


_TOKEN_COUNTS = """
tc AS (SELECT doc_id, count(*) FILTER (gold <> 'O' AND gold = pred) AS tp,
         count(*) FILTER (gold = 'O' AND pred <> 'O') AS fp, count(*) FILTER (gold <> 'O' AND gold <> pred) AS fn
       FROM kept GROUP BY 1),
tr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM tc)"""


@add(
    "g7_doc_scores",
    sql.with_(
        *sql.PAIR_MEMBERS, _TOKEN_COUNTS,
        body="""SELECT doc_id, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1,
                round(p, 4) AS precision, round(r, 4) AS recall, tp, fp, fn FROM tr""",
    ),
)
def g7(spark, sf):
    return ev.doc_scores(sequences(spark, sf))


def _esc(text: str) -> str:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = f"replace({text}, {sql.quote(char)}, {sql.quote(name)})"
    return text


def _mark(note: str, outcome: str) -> str:
    return f"""'<b class="{outcome}">' || {_esc('k.text')} || ' <small>' || {_esc(note)} || '</small></b>'"""


@add(
    "g8_annotate_html",
    sql.with_(
        *sql.PAIR_MEMBERS,
        body=f"""SELECT d.doc_id, {sql.quote(rep.STYLE)} || '<div class="seq">' || coalesce(string_agg(
                 CASE WHEN gold <> 'O' AND gold = pred THEN {_mark('k.gold', rep.HIT)}
                      WHEN gold <> 'O' THEN {_mark("k.gold || '→' || k.pred", rep.WRONG)}
                      WHEN pred <> 'O' THEN {_mark('k.pred', rep.ALARM)}
                      ELSE {_esc('k.text')} END,
                 '' ORDER BY k.token_idx), '') || '</div>' AS annotated_sequence
                 FROM (SELECT doc_id FROM docs ORDER BY doc_id LIMIT 100) d LEFT JOIN kept k USING (doc_id)
                 GROUP BY d.doc_id""",
    ),
)
def g8(spark, sf):
    return rep.annotate_html(sequences(spark, sf, first=100))


@add(
    "g9_prediction_table",
    sql.with_(
        *sql.PAIR_MEMBERS,
        body="""SELECT d.doc_id, coalesce(string_agg(k.text, ' ' ORDER BY k.token_idx), '') AS sequence,
                  coalesce(string_agg(k.gold, ' ' ORDER BY k.token_idx), '') AS true_labels,
                  coalesce(string_agg(k.pred, ' ' ORDER BY k.token_idx), '') AS pred_labels,
                  printf('%.2f', 100.0 * count(*) FILTER (k.gold = k.pred) / count(k.doc_id)) || '%' AS accuracy
                FROM (SELECT doc_id FROM docs ORDER BY doc_id LIMIT 50) d LEFT JOIN kept k USING (doc_id)
                GROUP BY d.doc_id""",
    ),
)
def g9(spark, sf):
    return rep.prediction_table(sequences(spark, sf, first=50))


@add(
    "g10_worst_labels",
    sql.with_(
        *sql.SCORE_MEMBERS,
        body=f"SELECT label, {_ROUND}, n_true AS support FROM rates ORDER BY rates.f1, label LIMIT 3",
    ),
)
def g10(spark, sf):
    return rounded(ev.worst_labels(ev.entity_scores(stacked(spark, sf)), 3), "precision", "recall", "f1")


def _report(order: str, limit: str) -> str:
    return sql.with_(
        *sql.SCORE_MEMBERS,
        body=f"""SELECT '| Entity | F1 | Support |' || chr(10) || '|--------|------|---------|' || chr(10)
                 || string_agg('| ' || label || ' | ' || printf('%.4f', f1) || ' | ' || n_true || ' |' || chr(10), '' ORDER BY {order})
                 AS report FROM (SELECT label, f1, n_true FROM rates ORDER BY {order} {limit})""",
    )


@add("g11_entity_report", _report("label", ""))
def g11(spark, sf):
    return rep.entity_report(ev.entity_scores(stacked(spark, sf)))


@add("g11_entity_report_worst", _report("f1, label", "LIMIT 3"))
def g11_worst(spark, sf):
    return rep.entity_report(ev.entity_scores(stacked(spark, sf)), worst=3)


_FLAT = """
flat AS (
  SELECT label || '_f1' AS metric, f1 AS value FROM rates
  UNION ALL SELECT label || '_support', CAST(n_true AS DOUBLE) FROM rates
  UNION ALL SELECT 'precision', sum(tp) / sum(n_pred) FROM rates
  UNION ALL SELECT 'recall', sum(tp) / sum(n_true) FROM rates
  UNION ALL SELECT 'f1', 2 * sum(tp) / (sum(n_true) + sum(n_pred)) FROM rates
  UNION ALL SELECT 'accuracy', avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) FROM kept)"""


def flat(spark, sf):
    kept = sequences(spark, sf)
    return ev.flat_metrics(ev.stack_sequences(tag_columns(kept)), kept)


@add(
    "g5_flat_metrics",
    sql.with_(*sql.SCORE_MEMBERS, _FLAT, body="SELECT metric, round(value, 6) AS value FROM flat"),
)
def g5_flat(spark, sf):
    return rounded(flat(spark, sf), "value")


@add(
    "b10_split_by_metric",
    sql.with_(
        *sql.SCORE_MEMBERS, _FLAT,
        body="""SELECT metric, round(value, 6) AS value, CASE WHEN value < 0.9 THEN 'missed' ELSE 'passed' END AS outcome
                FROM flat WHERE value < 0.9 OR metric NOT LIKE '%support'""",
    ),
)
def b10(spark, sf):
    return rounded(split_by_metric(flat(spark, sf)), "value")


_LOGS = """
logs AS (
  SELECT 'run-' || user_id AS run, CAST(dayofmonth(ts) AS INT) AS checkpoint,
         CAST(row_number() OVER (PARTITION BY user_id, dayofmonth(ts) ORDER BY ts, event_id) - 1 AS INT) AS pos,
         CAST(hour(ts) AS BIGINT) AS step, CASE WHEN event_type <> 'error' THEN round(value / 1000, 6) END AS eval_f1,
         max(CAST(hour(ts) AS BIGINT)) OVER (PARTITION BY user_id, dayofmonth(ts)) AS best_step
  FROM events),
best AS (
  SELECT l.run, n.checkpoint, n.best_step,
         (SELECT min_by(k.eval_f1, k.pos) FROM logs k WHERE k.run = l.run AND k.checkpoint = n.checkpoint
            AND k.step = k.best_step AND k.eval_f1 IS NOT NULL) AS eval_f1
  FROM (SELECT run, max(checkpoint) AS top FROM logs GROUP BY 1) l
  JOIN (SELECT DISTINCT run, checkpoint, best_step FROM logs) n ON n.run = l.run AND n.checkpoint = l.top)"""


def run_logs(spark, sf):
    """Training logs read off the events: user as run, day as checkpoint, hour as step."""
    keyed = keyed_logs(table(spark, sf, "events"))
    best = keyed.groupBy("run", "checkpoint").agg(F.max("step").alias("best_step"))
    return keyed.join(best, ["run", "checkpoint"])


def keyed_logs(events):
    return events.select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run"),
        F.dayofmonth("ts").alias("checkpoint"),
        F.hour("ts").cast("long").alias("step"),
        F.when(F.col("event_type") != "error", F.round(F.col("value") / 1000, 6)).alias("eval_f1"),
        F.struct("ts", "event_id").alias("pos"),
    )


@add("g12_best_log", sql.with_(_LOGS, body="SELECT run, checkpoint, best_step, eval_f1 FROM best"))
def g12(spark, sf):
    return rep.best_log(run_logs(spark, sf))


@add(
    "a6_run_logs",
    """WITH logs AS (
         SELECT 'run-' || (user_id % 10) AS run, CAST(dayofmonth(ts) AS INT) AS checkpoint, CAST(hour(ts) AS BIGINT) AS step,
                CASE WHEN event_type <> 'error' THEN round(value / 1000, 6) END AS eval_f1 FROM events)
       SELECT run, checkpoint, 'out/' || run || '/checkpoint-' || checkpoint AS best_checkpoint,
              max(step) OVER (PARTITION BY run, checkpoint) AS best_step, step, eval_f1, n
       FROM (SELECT run, checkpoint, step, eval_f1, count(*) AS n FROM logs GROUP BY ALL)""",
)
def a6(spark, sf):
    """A tree of state files, one per run and checkpoint, written and read back."""
    path = shared_dir(spark)
    events = table(spark, sf, "events").withColumn("user_id", F.col("user_id") % 10)
    logs = keyed_logs(events)
    state = logs.groupBy("run", "checkpoint").agg(
        F.max("step").alias("best_global_step"),
        F.collect_list(
            F.when(
                F.col("eval_f1").isNotNull(),
                F.create_map(F.lit("step"), F.col("step").cast("double"), F.lit("eval_f1"), F.col("eval_f1")),
            ).otherwise(F.create_map(F.lit("step"), F.col("step").cast("double")))
        ).alias("log_history"),
    )
    folder = F.concat(F.lit("checkpoint-"), F.col("checkpoint").cast("string"))
    best = F.concat(F.lit("out/"), "run", F.lit("/"), folder)
    text = F.to_json(F.struct(best.alias("best_model_checkpoint"), "best_global_step", "log_history"))
    write_run_logs(state.select("run", "checkpoint", text.alias("value")), path)
    back = read_run_logs(spark, path)
    return back.groupBy("run", "checkpoint", "best_checkpoint", "best_step", "step", "eval_f1").agg(F.count("*").alias("n"))


@add("g12_first_checkpoint", sql.with_(_LOGS, body="SELECT run, min(checkpoint) AS checkpoint FROM logs GROUP BY 1"))
def g12_first(spark, sf):
    return rep.first_checkpoint(run_logs(spark, sf))


@add(
    "g13_compare_runs",
    sql.with_(
        _LOGS,
        body="""SELECT run, '| [' || run || ' tagger](' || 'models/' || run || ') | ' || printf('%.4f', eval_f1)
                  || ' | ' || n || ' events | ' || printf('%.1f', mean) || ' ms | ' || kind || ' |' AS row
                FROM best JOIN (SELECT 'run-' || user_id AS run, count(*) AS n, avg(value) AS mean, min(event_type) AS kind
                                FROM events GROUP BY 1) USING (run) WHERE eval_f1 IS NOT NULL""",
    ),
)
def g13(spark, sf):
    events = table(spark, sf, "events")
    run = F.concat(F.lit("run-"), F.col("user_id").cast("string"))
    registry = events.groupBy(run.alias("run")).agg(
        F.concat(F.count("*").cast("string"), F.lit(" events")).alias("size_label"),
        exact_mean(F.col("value")).alias("mean"),
        F.min("event_type").alias("best_for"),
    )
    registry = registry.withColumns(
        {
            "speed_label": F.concat(fixed(F.col("mean"), 1), F.lit(" ms")),
            "model_name": F.concat("run", F.lit(" tagger")),
            "link": F.concat(F.lit("models/"), "run"),
        }
    )
    scores = rep.best_log(run_logs(spark, sf)).where(F.col("eval_f1").isNotNull())
    return rep.compare_runs(registry, scores)
