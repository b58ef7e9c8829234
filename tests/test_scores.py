import json
import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions.format import exact_mean
from veilframe.functions.tags import argmax, tag_spans
from veilframe.operators import evaluate as ev
from veilframe.operators import reports as rep
from veilframe.operators.detect import aggregate_first
from veilframe.operators.rows import split_by_metric
from veilframe.operators.tagger import tagged_spans
from veilframe.sources.run_logs import read_run_logs


def sequences(spark, *tag_lists):
    return spark.createDataFrame([(i, list(t)) for i, t in enumerate(tag_lists)], "doc_id long, tags array<string>")


def spans_by_hand(tags):
    out, open_at = [], None
    for i, tag in enumerate(list(tags) + ["O"]):
        kind = tag[2:] if tag != "O" else None
        if open_at is not None and (kind != tags[open_at][2:] or tag.startswith("B-")):
            out.append((tags[open_at][2:], open_at, i - 1))
            open_at = None
        if kind is not None and open_at is None:
            open_at = i
    return out


def test_lenient_iob(spark):
    rng = random.Random(2)
    lists = ["B-A I-A O I-B I-A B-A".split(), [], ["O"], ["I-A"], "B-A B-A I-B I-B B-B O I-B".split()]
    lists += [[rng.choice(["O", "B-A", "I-A", "B-B", "I-B"]) for _ in range(rng.randint(1, 40))] for _ in range(60)]
    rows = ev.tags_to_spans(sequences(spark, *lists), "tags").collect()
    for i, tags in enumerate(lists):
        assert sorted((r.first, r.last, r.label) for r in rows if r.doc_id == i) == sorted(
            (a, b, k) for k, a, b in spans_by_hand(tags)
        )
    assert [tuple(s) for s in sequences(spark, lists[0]).select(tag_spans(F.col("tags"))).first()[0]] == [
        ("A", 0, 1), ("B", 3, 3), ("A", 4, 4), ("A", 5, 5),
    ]


def test_argmax(spark):
    df = spark.createDataFrame([([0.1, 0.8, 0.1],), ([0.7, 0.2, 0.1],), ([0.5, 0.5],)], "s array<double>")
    assert [r[0] for r in df.select(argmax(F.col("s"))).collect()] == [1, 0, 0]


def test_span_scores(spark):
    rows = spark.createDataFrame(
        [(0, "B-A I-A O B-B".split(), "B-A I-A O B-A".split()), (1, "O B-B".split(), "O B-B".split()), (2, ["O"], ["B-C"])],
        "doc_id long, gold array<string>, pred array<string>",
    )
    stacked = ev.stack_sequences(rows)
    tables = ev.stack_spans(ev.tags_to_spans(rows, "gold"), ev.tags_to_spans(rows, "pred"))
    for both in (stacked, tables):
        got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in ev.entity_scores(both).collect()}
        assert got["A"] == (0.5, 1.0, pytest.approx(2 / 3), 1)
        assert got["B"] == (1.0, 0.5, pytest.approx(2 / 3), 2)
        assert got["C"] == (0.0, 0.0, 0.0, 0)
        all_ = ev.overall_scores(both).first()
        assert (all_.precision, all_.recall, all_.support) == (0.5, pytest.approx(2 / 3), 3)
        assert all_.macro_f1 == pytest.approx(4 / 9) and all_.micro_f1 == pytest.approx(4 / 7)
    assert ev.overall_scores(stacked.where("false")).first().micro_f1 == 0.0


def test_token_counts(spark):
    pairs = zip("B-A I-A O O".split(), "B-A O B-B O".split())
    tokens = spark.createDataFrame([(0, g, p) for g, p in pairs] + [(1, "O", "O")], "doc_id long, gold string, pred string")
    rows = ev.gathered(tokens)
    got = {r.doc_id: r for r in ev.doc_scores(rows).collect()}
    assert (got[0].tp, got[0].fn, got[0].fp, got[0].precision, got[0].recall, got[0].f1) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert (got[1].tp, got[1].f1) == (0, 0.0)
    assert ev.token_accuracy(rows).first().accuracy == pytest.approx(0.6)


def test_decode(spark):
    vocab = spark.createDataFrame([(0, "O"), (1, "B-A")], "label_id int, label string")
    tokens = spark.createDataFrame([(0, 0, 1, 0), (0, 1, -100, 1), (0, 2, 0, 1)], "doc_id long, token_idx int, gold_id int, pred_id int")
    got = {r.token_idx: (r.gold, r.pred) for r in ev.decode_tags(tokens, vocab).collect()}
    assert got == {0: ("B-A", "O"), 2: ("O", "B-A")}


def test_html_and_table(spark):
    tokens = [(("<b>",), "O", "O"), (("x",), "B-A", "B-A"), (("y",), "B-A", "O"), (("&",), "O", "B-B")]
    df = spark.createDataFrame(
        [(i, tokens) for i in range(3)], "doc_id long, tokens array<struct<token:struct<text:string>,gold:string,pred:string>>"
    )
    rows = rep.annotate_html(df, limit=2).collect()
    assert len(rows) == 2
    html = rows[0].annotated_sequence
    assert "&lt;b&gt;" in html and "B-A→O" in html and "&amp;" in html
    assert all(html.count(f'<b class="{x}">') == 1 for x in (rep.HIT, rep.WRONG, rep.ALARM))
    row = rep.prediction_table(df, 1).first()
    assert (row.sequence, row.true_labels, row.accuracy) == ("<b> x y &", "O B-A B-A O", "50.00%")


def test_report(spark):
    schema = "label string, f1 double, support long"
    header = "| Entity | F1 | Support |\n|--------|------|---------|\n"
    assert rep.entity_report(spark.createDataFrame([], schema)).first().report == header
    scores = spark.createDataFrame([("TEL", 0.5, 3), ("EMAIL", 0.98765, 7), ("IP", None, 2), ("OTHER", 0.1, 1)], schema)
    want = "| EMAIL | 0.9877 | 7 |\n", "| TEL | 0.5000 | 3 |\n"
    assert rep.entity_report(scores).first().report == header + want[0] + want[1]
    assert rep.entity_report(scores, worst=1).first().report == header + want[1]
    assert [r.label for r in ev.worst_labels(scores.where("f1 is not null"), 1).collect()] == ["OTHER"]


def test_missed_and_passed(spark):
    rows = [("a_f1", 0.95), ("b_f1", 0.2), ("a_support", 9.0), ("b_support", 0.0)]
    got = {r.metric: r.outcome for r in split_by_metric(spark.createDataFrame(rows, "metric string, value double")).collect()}
    assert got == {"a_f1": "passed", "b_f1": "missed", "b_support": "missed"}


def write_state(path, best, history):
    path.mkdir(parents=True)
    (path / "trainer_state.json").write_text(
        json.dumps({"best_model_checkpoint": str(path), "best_global_step": best, "log_history": history}, indent=1)
    )


def test_run_choice(spark, tmp_path):
    write_state(tmp_path / "m1" / "checkpoint-50", 50, [{"step": 50, "eval_f1": 0.9}])
    write_state(
        tmp_path / "m1" / "checkpoint-200", 200,
        [{"step": 50, "eval_f1": 0.9}, {"step": 200, "loss": 0.1}, {"step": 200, "eval_f1": 0.96, "eval_TEL_f1": 0.5, "eval_TEL_support": 4},
         {"step": 200, "eval_f1": 0.1}],
    )
    write_state(tmp_path / "m2" / "checkpoint-9", 9, [{"step": 8, "eval_f1": 0.3}])
    logs = read_run_logs(spark, str(tmp_path))
    best = {r.run: (r.checkpoint, r.best_step, r.eval_f1) for r in rep.best_log(logs).collect()}
    assert best == {"m1": (200, 200, 0.96), "m2": (9, 9, None)}
    assert {r.run: r.checkpoint for r in rep.first_checkpoint(logs).collect()} == {"m1": 50, "m2": 9}
    metrics = rep.log_metrics(rep.best_metrics(logs)).collect()
    assert [(r.run, r.label, r.f1, r.support) for r in metrics] == [("m1", "TEL", 0.5, 4)]
    registry = spark.createDataFrame([("m1", "One", "u", "S", "fast", "all")], "run string, model_name string, link string, size_label string, speed_label string, best_for string")
    rows = rep.compare_runs(registry, rep.best_log(logs)).collect()
    assert [r.row for r in rows] == ["| [One](u) | 0.9600 | S | fast | all |"]


def groups_by_hand(words):
    """``words`` are word_id, start, end, tag, score of consecutive words."""
    out = []
    for word_id, start, end, tag, score in words:
        if tag == "O":
            continue
        last = out[-1] if out else None
        if last and last["at"] == word_id - 1 and last["label"] == tag[2:] and not tag.startswith("B-"):
            last.update(at=word_id, end=end)
            last["scores"].append(score)
        else:
            out.append({"at": word_id, "start": start, "end": end, "label": tag[2:], "scores": [score]})
    return [(g["start"], g["end"], g["label"], round(sum(g["scores"]) / len(g["scores"]), 6)) for g in out]


@pytest.mark.parametrize("segment", [1, 5, 4096])
def test_first_token_aggregation(spark, segment):
    rng = random.Random(segment)
    tokens, words = [], {}
    for doc in range(20):
        at, words[doc] = 0, []
        for word in range(rng.randint(0, 30)):
            parts = [rng.randint(1, 4) for _ in range(rng.randint(1, 3))]
            begin, end = at, at + sum(parts)
            for part in parts:
                tag, score = rng.choice(["O", "O", "B-A", "I-A", "I-B"]), rng.randint(1, 9) / 10
                tokens.append((doc, word, at, begin, end, tag, score))
                if at == begin:
                    words[doc].append((word, begin, end, tag, score))
                at += part
    df = spark.createDataFrame(tokens, "doc_id long, word_id int, start int, word_start int, word_end int, tag string, score double")
    want = sorted((d, *g) for d, ws in words.items() for g in groups_by_hand(ws))
    rows = tagged_spans(df, segment=segment).collect()
    assert sorted((r.doc_id, r.start, r.end, r.label, round(r.score, 6)) for r in rows) == want
    nested = df.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "word_id", "word_start", "word_end", "tag", "score"))).alias("tokens")
    )
    rows = aggregate_first(nested).collect()
    assert sorted((r.doc_id, r.start, r.end, r.label, round(r.score, 6)) for r in rows) == want


def test_a_mean_does_not_depend_on_the_order_of_rows(spark):
    values = [0.1] * 7 + [1e16, 41.75, -1e16]
    df = spark.createDataFrame([(g, v) for g, vs in ((0, values), (1, values[::-1]), (2, [None])) for v in vs], "g int, v double").coalesce(1)
    got = {r.g: r.m for r in df.groupBy("g").agg(exact_mean(F.col("v")).alias("m")).collect()}
    assert got == {0: 4.245, 1: 4.245, 2: None}
    odd = spark.createDataFrame([(float("inf"),), (1e30,), (0.5,)], "v double")
    assert odd.agg(exact_mean(F.col("v"))).first()[0] == float("inf")
