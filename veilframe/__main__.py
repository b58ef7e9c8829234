"""Jobs for ``spark-submit``: redact a folder of texts, prepare a corpus.

    python -m veilframe redact --path in/ --output out/ --threshold 0.5
    python -m veilframe prepare --path corpus/ --output prepared/ --rare-threshold 50
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.labels import total_label_counts
from .operators.rows import mask_rows
from .plans.prepare import prepare_corpus
from .plans.redact import DEFAULT_THRESHOLD, redact_documents
from .sources.corpus import label_info, write_corpus, write_label_info
from .sources.texts import read_texts, redaction_json, write_redactions


def redact(spark: SparkSession, args: argparse.Namespace) -> None:
    texts = read_texts(spark, [args.text] if args.text is not None else None, args.path)
    done = redact_documents(
        texts, threshold=args.threshold, max_length=args.max_length, stride=args.stride
    )
    if args.output:
        write_redactions(done, args.output)
    else:
        if args.text is None:
            raise SystemExit("a folder of texts needs --output")
        for row in redaction_json(done).collect():  # the one text given
            print(row.value)


def prepare(spark: SparkSession, args: argparse.Namespace) -> None:
    raw = spark.read.parquet(args.path)
    done = prepare_corpus(raw, args.language, args.rare_threshold)
    done.check()  # before anything is saved
    write_corpus(done.corpus, f"{args.output}/corpus")
    masks = mask_rows(done.corpus, "split")
    train = masks.where("split = 'train'")
    info = label_info(done.vocab, total_label_counts(masks), total_label_counts(train))
    write_label_info(info, f"{args.output}/label_info")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="veilframe")
    jobs = top.add_subparsers(dest="job", required=True)

    job = jobs.add_parser("redact", help="replace personal data by typed placeholders")
    source = job.add_mutually_exclusive_group(required=True)
    source.add_argument("--text")
    source.add_argument("--path")
    job.add_argument("--output")
    job.add_argument("--threshold", type=float, default=DEFAULT_THRESHOLD)
    job.add_argument("--stride", type=float, default=0.5)
    job.add_argument("--max-length", type=int, default=512)
    job.set_defaults(run=redact)

    job = jobs.add_parser("prepare", help="clean, split and describe a labelled corpus")
    job.add_argument("--path", required=True)
    job.add_argument("--output", required=True)
    job.add_argument("--language", default="English")
    job.add_argument("--rare-threshold", type=int, default=50)
    job.set_defaults(run=prepare)
    return top


def main() -> None:
    args = parser().parse_args()
    args.run(SparkSession.builder.appName("veilframe").getOrCreate(), args)


if __name__ == "__main__":
    main()
