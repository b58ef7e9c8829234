from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from veilframe.__main__ import parser
from veilframe.plans.requests import serve_requests, served_log
from veilframe.plans.silver import MASK
from veilframe.session import shared_dir
from veilframe.sources.corpus import read_corpus, read_label_info
from veilframe.sources.run_logs import read_run_logs
from veilframe.sources.texts import read_redactions


def run(spark, *argv):
    args = parser().parse_args([str(a) for a in argv])
    args.run(spark, args)


def test_redact_job(spark, tmp_path, capsys):
    run(spark, "redact", "--text", "My email is john@example.com")
    assert '"redacted":"My email is [EMAIL]"' in capsys.readouterr().out
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ip 1.2.3.4")
    run(spark, "redact", "--path", tmp_path / "in", "--output", tmp_path / "out", "--threshold", 0.96)
    assert read_redactions(spark, str(tmp_path / "out")).first().redacted == "ip 1.2.3.4"
    for bad in (["redact"], ["redact", "--text", "a", "--path", "b"]):
        with pytest.raises(SystemExit):
            parser().parse_args(bad)


def test_prepare_job(spark, tmp_path):
    rows = [(i, f"t{i}", [(0, 1, "A")], "English", "train" if i < 8 else "validation") for i in range(12)]
    rows.append((50, "r", [(0, 1, "RARE")], "English", "train"))
    schema = f"doc_id long, source_text string, privacy_mask array<{MASK}>, language string, split string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "raw"))
    run(spark, "prepare", "--path", tmp_path / "raw", "--output", tmp_path / "out", "--rare-threshold", 2)
    corpus = read_corpus(spark, str(tmp_path / "out" / "corpus"))
    assert {r["split"]: r["count"] for r in corpus.groupBy("split").count().collect()} == {
        "train": 9, "validation": 2, "test": 2,
    }
    info = read_label_info(spark, str(tmp_path / "out" / "label_info")).first()
    assert info.entities == ["A"] and info.all_entities_counted == {"A": 12} and info.train_counted_entities == {"A": 8}


def test_served_requests(spark):
    base = datetime(2024, 1, 1)
    rows = [(f"r{i:02}", base + timedelta(minutes=i), "ip 1.2.3.4", None, "9.9.9.9, x", "h") for i in range(12)]
    rows[3] = ("r03", base, "   ", None, "9.9.9.9", "h")
    rows.append(("s", base, "low 1.2.3.4", 0.99, None, "other"))
    df = spark.createDataFrame(
        rows, "request_id string, ts timestamp, text string, threshold double, forwarded string, host string"
    ).withColumns({"api_key": F.lit(None).cast("string"), "endpoint": F.lit("/r"), "method": F.lit("POST"), "duration": F.lit(0.001)})
    out = {r.request_id: r for r in serve_requests(df).collect()}
    assert [k for k, r in sorted(out.items()) if r.status_code == 422] == ["r03"] and out["r03"].reason == "blank"
    assert [k for k, r in sorted(out.items()) if r.status_code == 429] == ["r11"] and out["r11"].redacted is None
    assert out["r10"].redacted == "ip [IP]" and out["s"].redacted == "low 1.2.3.4"
    log = {r.request_id: r for r in served_log(serve_requests(df)).collect()}
    assert (log["r00"].text_length, log["r00"].entity_count, log["r11"].text_length, log["r11"].entity_count) == (10, 1, None, None)
    assert "1.2.3.4" not in str(log["r00"])
    assert all(r.status_code == 200 for r in serve_requests(df.where("request_id <> 'r03'"), limit=None).collect())


def test_no_checkpoint(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_run_logs(spark, str(tmp_path))


def test_shared_folder_follows_the_session(spark):
    assert "veilframe" in shared_dir(spark)
    settings = {"spark.checkpoint.dir": "s3://bucket/ckpt/"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: settings.get(key, default)))
    assert shared_dir(session).startswith("s3://bucket/ckpt/veilframe/")
    settings = {"spark.master": "spark://host:7077"}
    with pytest.raises(ValueError):
        shared_dir(session)
