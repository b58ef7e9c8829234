import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions.tags import CONTAIN, MODES, OVERLAP, WORD_UNION, WORD_UNION_STICKY, bio_tags
from veilframe.operators import labels as lab
from veilframe.operators import rows
from veilframe.operators.alignment import align, audit_alignment, class_weights, encode_labels, stray_tokens, with_tags
from veilframe.operators.tokens import with_tokens
from veilframe.plans.prepare import prepare_corpus
from veilframe.sources import corpus as src

CORPUS = (
    "doc_id long, source_text string, privacy_mask array<struct<start:int,end:int,label:string>>, "
    "language string, split string"
)
NAME = "John Doe x Roe"


def corpus(spark, *masks, text=NAME):
    return spark.createDataFrame([(i, text, list(m), "en", "train") for i, m in enumerate(masks)], CORPUS)


FIRST = [(0, 4, "N"), (5, 8, "N"), (11, 14, "N")]
SECOND = [(0, 8, "N"), (5, 8, "M")]


@pytest.mark.parametrize(
    "mode, first, second",
    [
        (WORD_UNION, "B-N I-N O B-N", "B-N B-M O O"),
        (WORD_UNION_STICKY, "B-N I-N O I-N", "B-N B-M O O"),
        (OVERLAP, "B-N B-N O B-N", "B-N I-N O O"),
        (CONTAIN, "B-N O O O", "B-N I-N O O"),
    ],
)
def test_alignment_golden(spark, mode, first, second):
    out = align(corpus(spark, FIRST, SECOND, []), mode).orderBy("doc_id", "token_idx").collect()
    tags = [" ".join(r.tag for r in out if r.doc_id == i) for i in range(3)]
    assert tags == [first, second, "O O O O"]


def tags_by_hand(tokens, masks, mode):
    """Sequential statement of the four alignment rules."""
    out, previous = [], None
    for i, t in enumerate(tokens):
        by_word = mode in (WORD_UNION, WORD_UNION_STICKY)
        lo, hi = (t["word_start"], t["word_end"]) if by_word else (t["start"], t["end"])
        inside = [m for m in masks if (lo >= m[0] and hi <= m[1] if mode == CONTAIN else lo < m[1] and hi > m[0])]
        hit = None if not inside else inside[-1] if by_word else inside[0]
        if hit is None:
            out.append("O")
            previous = previous if mode == WORD_UNION_STICKY else None
            continue
        if by_word:
            goes_on = previous == hit[2] or (i > 0 and tokens[i - 1]["word_id"] == t["word_id"])
        else:
            goes_on = lo != hit[0] if mode == CONTAIN else lo > hit[0]
        out.append(("I-" if goes_on else "B-") + hit[2])
        previous = hit[2]
    return out


@pytest.mark.parametrize("mode", MODES)
def test_alignment_random(spark, mode):
    rng = random.Random(4)
    data = []
    for doc in range(25):
        text = "".join(rng.choice(["ab", "c-d", "e.f", "g"]) + rng.choice([" ", " ", "  ", ""]) for _ in range(rng.randint(0, 150)))
        masks = []
        for _ in range(rng.randint(0, 12)):
            start = rng.randint(0, max(0, len(text) - 1))
            masks.append((start, start + rng.randint(1, 9), rng.choice("AB")))
        data.append((doc, text, masks, "en", "train"))
    df = with_tokens(spark.createDataFrame(data, CORPUS), "source_text")
    for r in df.withColumn("tags", bio_tags(F.col("tokens"), F.col("privacy_mask"), mode)).collect():
        tokens = [t.asDict() for t in r.tokens]
        assert r.tags == tags_by_hand(tokens, [tuple(m) for m in r.privacy_mask], mode)


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        bio_tags(F.col("tokens"), F.col("privacy_mask"), "other")


def vocab_of(spark, *entities):
    rows_ = [("O", 0, None, "O")]
    for i, e in enumerate(entities):
        rows_ += [(f"B-{e}", 1 + 2 * i, e, "B"), (f"I-{e}", 2 + 2 * i, e, "I")]
    return spark.createDataFrame(rows_, src.VOCAB_SCHEMA)


def test_label_ids(spark):
    tokens = spark.createDataFrame(
        [(0, None, 0, 0, None), (1, 0, 0, 0, "B-EMAIL"), (2, 0, 3, 0, "I-EMAIL"), (3, 1, 5, 5, "O"), (4, 1, 6, 5, "O"), (5, None, 0, 0, None)],
        "token_idx int, word_id int, start int, word_start int, tag string",
    )
    vocab = vocab_of(spark, "EMAIL")
    got = [r.label_id for r in encode_labels(tokens, vocab).orderBy("token_idx").collect()]
    assert got == [-100, 1, -100, 0, 0, -100]
    other = tokens.withColumn("tag", F.regexp_replace("tag", "EMAIL", "GONE"))
    got = [r.label_id for r in encode_labels(other, vocab, unknown=0).orderBy("token_idx").collect()]
    assert got == [-100, 0, -100, 0, -100, -100]


def test_class_weights(spark):
    tokens = spark.createDataFrame([(i,) for i in [0, 0, 0, 0, 1, -100, -100]], "label_id int")
    got = {r.label_id: (r.n, r.weight) for r in class_weights(tokens, vocab_of(spark, "E")).collect()}
    assert got[0] == (4, pytest.approx(1 / 9)) and got[1] == (1, pytest.approx(4 / 9))
    assert got[2] == (0, pytest.approx(4 / 9))


def test_rare_and_drop(spark):
    df = corpus(spark, [(0, 1, "A")] * 3 + [(2, 3, "B")], [(0, 1, "B")], [])
    masks = rows.mask_rows(df, "doc_id", "split")
    rare = rows.rare_labels(masks, 3)
    assert [(r.label, r.n) for r in rare.collect()] == [("B", 2)]
    assert rows.rare_labels(masks, 2).count() == 0
    out = rows.drop_labels(df, rare)
    got = {r.doc_id: [m.label for m in r.privacy_mask] for r in out.collect()}
    assert got == {0: ["A"] * 3, 1: [], 2: []}
    assert rows.count_removed(df, out).first().removed == 2
    rows.assert_absent(rows.mask_rows(out, "doc_id"), rare)
    with pytest.raises(AssertionError):
        rows.assert_absent(masks, rare)
    assert rows.drop_labels(df, rare.where("false")).collect() == df.collect()


def test_drop_labels_and_nulls(spark):
    mask = "array<struct<start:int,end:int,label:string>>"
    df = spark.createDataFrame([(7, [(0, 1, "A"), (1, 2, None), (2, 3, "B")]), (7, [(0, 1, "B")]), (8, None)], f"doc_id long, privacy_mask {mask}")

    def left(*labels):
        out = rows.drop_labels(df, spark.createDataFrame([(x,) for x in labels], "label string"))
        return [None if r.privacy_mask is None else [m.label for m in r.privacy_mask] for r in out.collect()]

    assert left("B") == [["A", None], [], None]
    assert left(None) == [["A", "B"], ["B"], None]
    assert left("A", None) == [["B"], ["B"], None]
    gone = rows.mask_rows(df, "doc_id")
    assert rows.labels_left(gone, spark.createDataFrame([(None,)], "label string")).first().n == 1


def test_vocabulary(spark):
    df = corpus(spark, [(0, 1, "Z"), (2, 3, "A")], [(0, 1, "A"), (4, 5, "M")])
    vocab = lab.build_vocab(rows.mask_rows(df, "doc_id"))
    ids = {r.label: r.label_id for r in vocab.collect()}
    assert ids == {"O": 0, "B-Z": 1, "I-Z": 2, "B-A": 3, "I-A": 4, "B-M": 5, "I-M": 6}
    assert [r.entity for r in lab.entity_types(vocab).collect()] == ["A", "M", "Z"]
    assert {(r.label_id, r.label) for r in lab.id2label(vocab).collect()} == {(v, k) for k, v in ids.items()}
    names = vocab_of(spark, *[f"T{i}" for i in range(27)])
    assert names.count() == 55


def test_counts(spark):
    df = corpus(spark, [(0, 1, "A"), (0, 1, "B")], [(0, 1, "A")])
    masks = rows.mask_rows(df, "doc_id", "split")
    got = {(r.split, r.label): r.n for r in lab.label_counts(masks).collect()}
    assert got == {("train", "A"): 2, ("train", "B"): 1, ("train", None): 3, (None, None): 3}
    totals = lab.total_label_counts(masks)
    assert [r.label for r in lab.least_common(totals, 1).collect()] == ["B"]
    assert [r.label for r in lab.most_common(totals, 1).collect()] == ["A"]


@pytest.mark.parametrize("n", [0, 1, 2, 9, 1000])
def test_halves_are_exact_and_repeatable(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"))
    once = {r.doc_id: r.half for r in lab.split_half(df).collect()}
    again = {r.doc_id: r.half for r in lab.split_half(df.repartition(5)).collect()}
    assert once == again and len(once) == n
    assert sum(h == "test" for h in once.values()) == (n + 1) // 2
    if n == 1000:
        assert once != {r.doc_id: r.half for r in lab.split_half(df, seed=7).collect()}


def test_shares(spark):
    df = spark.createDataFrame([("a",)] * 2 + [("b",)], "split string")
    assert {r.split: r.percent for r in lab.split_shares(df).collect()} == {"a": 66.67, "b": 33.33}


def test_audits(spark):
    df = with_tags(with_tokens(corpus(spark, FIRST, [(0, 2, "N")], text="John Doe, x Roe"), "source_text"))
    audit = {r.doc_id: r for r in audit_alignment(df).collect()}
    assert (audit[0].n_masks, audit[0].n_entities, audit[0].counts_match) == (3, 2, False)
    assert (audit[1].n_masks, audit[1].n_entities, audit[1].counts_match) == (1, 1, True)
    stray = [(r.doc_id, r.start, r.end, r.tag) for r in stray_tokens(df).collect()]
    assert stray == [(0, 8, 9, "I-N")]


def test_corpus_round_trip(spark, tmp_path):
    df = corpus(spark, FIRST, SECOND).withColumn("split", F.when(F.col("doc_id") == 0, "train").otherwise("test"))
    src.write_corpus(df.drop("language"), str(tmp_path / "c"))
    assert src.read_corpus(spark, str(tmp_path / "c")).count() == 2
    back = src.read_corpus(spark, str(tmp_path / "c"), "test").collect()
    assert [[tuple(m) for m in r.privacy_mask] for r in back] == [SECOND]


def test_label_info_round_trip(spark, tmp_path):
    masks = rows.mask_rows(corpus(spark, [(0, 1, "Z"), (2, 3, "A")]), "doc_id")
    vocab, counts = lab.build_vocab(masks), lab.total_label_counts(masks)
    src.write_label_info(src.label_info(vocab, counts, counts.where("label = 'A'")), str(tmp_path / "i"))
    info = src.read_label_info(spark, str(tmp_path / "i")).first()
    assert info.entities == ["Z", "A"] and info.id2label == {0: "O", 1: "B-Z", 2: "I-Z", 3: "B-A", 4: "I-A"}
    assert info.label2id["B-A"] == 3
    assert info.all_entities_counted == {"A": 1, "Z": 1} and info.train_counted_entities == {"A": 1}
    src.write_vocab(vocab, str(tmp_path / "v"))
    assert {tuple(r) for r in src.read_vocab(spark, str(tmp_path / "v")).collect()} == {tuple(r) for r in vocab.collect()}


def test_prepare(spark):
    data = [
        (0, "t", [(0, 1, "A"), (0, 1, "R")], "English", "train"),
        (1, "t", [(0, 1, "A")], "English", "train"),
        (2, "t", [(0, 1, "A")], "French", "train"),
        (3, "t", [(0, 1, "R")], "English", "validation"),
        (4, "t", [], "English", "validation"),
        (5, "t", [], "English", "validation"),
    ]
    done = prepare_corpus(spark.createDataFrame(data, CORPUS), min_count=2)
    done.check()
    got = {r.doc_id: (r.split, len(r.privacy_mask)) for r in done.corpus.collect()}
    assert set(got) == {0, 1, 3, 4, 5} and got[0] == ("train", 1) and got[3][1] == 0
    assert sorted(s for s, _ in got.values()) == ["test", "test", "train", "train", "validation"]
    assert [r.label for r in done.vocab.orderBy("label_id").collect()] == ["O", "B-A", "I-A"]
