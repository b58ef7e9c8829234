"""Corpus preparation, vocabulary, splits and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bounded import broadcast_if_small
from ..functions.tags import CONTAIN, OVERLAP, WORD_UNION, WORD_UNION_STICKY
from ..operators import labels as lab
from ..operators import rows
from ..operators.alignment import (
    align,
    audit_alignment,
    class_weights,
    encode_labels,
    stray_tokens,
    with_tags,
)
from ..operators.tokens import with_tokens
from ..plans.prepare import prepare_corpus
from ..plans.silver import corpus
from ..session import shared_dir
from ..sources.corpus import (
    label_info,
    read_corpus,
    read_label_info,
    read_vocab,
    write_corpus,
    write_label_info,
    write_vocab,
)
from . import REGISTRY, sql

add = REGISTRY.add
RARE = 15

_SPLIT_MASKS = f"smasks AS (SELECT *, {sql.SPLIT} AS split FROM masks)"
_RARE = f"rare AS (SELECT label, count(*) AS n FROM smasks WHERE split = 'train' GROUP BY 1 HAVING count(*) < {RARE})"
_MASKS = (*sql.MASK_MEMBERS, _SPLIT_MASKS, _RARE)


def masks(spark, sf):
    return rows.mask_rows(corpus(spark, sf), "doc_id", "split")


def rare(spark, sf):
    return rows.rare_labels(masks(spark, sf).where(F.col("split") == "train"), RARE)


@add(
    "a1_read_corpus",
    sql.with_(
        *sql.MASK_MEMBERS,
        body=f"""SELECT d.doc_id, {sql.SPLIT.replace('doc_id', 'd.doc_id')} AS split, CAST(length(d.text) AS INT) AS n_chars,
                 CAST(count(m.doc_id) AS INT) AS n_masks FROM docs d LEFT JOIN masks m USING (doc_id)
                 GROUP BY d.doc_id, d.text""",
    ),
)
def a1(spark, sf):
    path = shared_dir(spark)
    write_corpus(corpus(spark, sf).drop("language"), path)
    back = read_corpus(spark, path)
    return back.select(
        "doc_id", "split", F.length("source_text").alias("n_chars"), F.size("privacy_mask").alias("n_masks")
    )


@add(
    "a3_write_corpus",
    sql.with_(
        *sql.MASK_MEMBERS,
        body=f"""SELECT doc_id, "start", "end", label FROM masks WHERE {sql.SPLIT} = 'validation'""",
    ),
)
def a3(spark, sf):
    path = shared_dir(spark)
    write_corpus(corpus(spark, sf).drop("language"), path)
    return rows.mask_rows(read_corpus(spark, path, "validation"), "doc_id").drop("mask_idx")


@add("a4_vocab_roundtrip", sql.with_(*sql.MASK_MEMBERS, sql.VOCAB, body="SELECT label, label_id, entity, bio FROM vocab"))
def a4(spark, sf):
    path = shared_dir(spark)
    write_vocab(lab.build_vocab(masks(spark, sf)), path)
    return read_vocab(spark, path)


@add(
    "a4_label_info",
    sql.with_(
        *_MASKS, sql.VOCAB,
        body="""SELECT v.label_id, v.label,
                  CAST(v2.label_id AS INT) AS back_id, coalesce(a.n, 0) AS n_all, coalesce(t.n, 0) AS n_train
                FROM vocab v JOIN vocab v2 ON v.label = v2.label
                LEFT JOIN (SELECT label, count(*) AS n FROM masks GROUP BY 1) a ON a.label = v.entity
                LEFT JOIN (SELECT label, count(*) AS n FROM smasks WHERE split = 'train' GROUP BY 1) t ON t.label = v.entity""",
    ),
)
def a4_info(spark, sf):
    path = shared_dir(spark)
    every = masks(spark, sf)
    train = every.where(F.col("split") == "train")
    write_label_info(
        label_info(lab.build_vocab(every), lab.total_label_counts(every), lab.total_label_counts(train)), path
    )
    info = read_label_info(spark, path)
    name = F.regexp_replace("label", "^[BI]-", "")
    return info.select("*", F.explode("id2label").alias("label_id", "label")).select(
        "label_id",
        "label",
        F.element_at("label2id", F.col("label")).alias("back_id"),
        F.coalesce(F.try_element_at("all_entities_counted", name), F.lit(0)).cast("long").alias("n_all"),
        F.coalesce(F.try_element_at("train_counted_entities", name), F.lit(0)).cast("long").alias("n_train"),
    )


@add("b1_filter_language", "SELECT doc_id, text AS source_text FROM documents WHERE lang = 'en'")
def b1(spark, sf):
    return rows.filter_language(corpus(spark, sf), "en").select("doc_id", "source_text")


@add(
    "b2_keep_columns",
    sql.with_(
        *sql.MASK_MEMBERS,
        body="""SELECT d.text AS source_text, CAST(count(m.doc_id) AS INT) AS n_masks
                FROM docs d LEFT JOIN masks m USING (doc_id) GROUP BY d.doc_id, d.text""",
    ),
)
def b2(spark, sf):
    kept = rows.keep_columns(corpus(spark, sf), ["source_text", "privacy_mask"])
    return kept.select("source_text", F.size("privacy_mask").alias("n_masks"))


@add("b3_rare_labels", sql.with_(*_MASKS, body="SELECT label, n FROM rare"))
def b3(spark, sf):
    return rare(spark, sf)


_KEPT = "kept_masks AS (SELECT * FROM smasks WHERE label NOT IN (SELECT label FROM rare))"


@add(
    "b4_drop_labels",
    sql.with_(
        *_MASKS, _KEPT,
        body="""SELECT d.doc_id, CAST(count(m.doc_id) AS INT) AS n_masks,
                  coalesce(string_agg(m.label || ':' || m."start" || ':' || m."end", '|' ORDER BY m.mask_idx), '') AS masks
                FROM docs d LEFT JOIN kept_masks m USING (doc_id) GROUP BY d.doc_id""",
    ),
)
def b4(spark, sf):
    cleaned = rows.drop_labels(corpus(spark, sf), rare(spark, sf))
    line = F.transform(
        "privacy_mask",
        lambda m: F.concat_ws(":", m["label"], m["start"].cast("string"), m["end"].cast("string")),
    )
    return cleaned.select(
        "doc_id", F.size("privacy_mask").alias("n_masks"), F.array_join(line, "|").alias("masks")
    )


@add(
    "b4_drop_null_labels",
    sql.with_(
        *sql.MASK_MEMBERS,
        """named AS (SELECT doc_id, mask_idx, CASE WHEN label = 'TIME' THEN NULL ELSE label END AS label FROM masks)""",
        body="""SELECT doc_id, mask_idx, label, false AS none_listed FROM named WHERE label IS NULL OR label <> 'IP'
                UNION ALL SELECT doc_id, mask_idx, label, true FROM named WHERE label IS NOT NULL AND label <> 'IP'""",
    ),
)
def b4_null(spark, sf):
    """Masks without a label stay, unless a null is among the labels to drop."""
    hidden = F.transform(
        "privacy_mask",
        lambda m: F.struct(m["start"], m["end"], F.when(m["label"] != "TIME", m["label"]).alias("label"), m["pos"].alias("pos")),
    )
    numbered = F.transform(
        "privacy_mask",
        lambda m, i: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["label"].alias("label"), i.alias("pos")),
    )
    named = corpus(spark, sf).withColumn("privacy_mask", numbered).withColumn("privacy_mask", hidden)

    def left(labels, listed):
        kept = rows.drop_labels(named, spark.createDataFrame([(x,) for x in labels], "label string"))
        masks = kept.select("doc_id", F.explode("privacy_mask").alias("m"))
        return masks.select("doc_id", F.col("m.pos").alias("mask_idx"), "m.label", F.lit(listed).alias("none_listed"))

    return left(["IP"], False).unionByName(left(["IP", None], True))


@add(
    "b5_count_removed",
    sql.with_(
        *_MASKS,
        body="SELECT CAST(count(*) AS BIGINT) AS removed FROM smasks WHERE label IN (SELECT label FROM rare)",
    ),
)
def b5(spark, sf):
    before = corpus(spark, sf)
    return rows.count_removed(before, rows.drop_labels(before, rare(spark, sf)))


@add(
    "b6_labels_left",
    sql.with_(
        *_MASKS, _KEPT,
        body="""SELECT 'before' AS state, label, count(*) AS n FROM smasks WHERE label IN (SELECT label FROM rare) GROUP BY ALL
                UNION ALL
                SELECT 'after', label, count(*) FROM kept_masks WHERE label IN (SELECT label FROM rare) GROUP BY ALL""",
    ),
)
def b6(spark, sf):
    before, few = corpus(spark, sf), rare(spark, sf)
    after = rows.drop_labels(before, few)
    left = [
        rows.labels_left(rows.mask_rows(state, "doc_id"), few).select(F.lit(name).alias("state"), "label", "n")
        for name, state in (("before", before), ("after", after))
    ]
    return left[0].unionByName(left[1])


@add(
    "f1_label_counts",
    sql.with_(*_MASKS, body="SELECT split, label, count(*) AS n FROM smasks GROUP BY ROLLUP (split, label)"),
)
def f1(spark, sf):
    return lab.label_counts(masks(spark, sf))


@add(
    "f2_least_common",
    sql.with_(*_MASKS, body="SELECT label, count(*) AS n FROM masks GROUP BY 1 ORDER BY n, label LIMIT 5"),
)
def f2(spark, sf):
    return lab.least_common(lab.total_label_counts(masks(spark, sf)), 5)


@add(
    "f2_most_common",
    sql.with_(*_MASKS, body="SELECT label, count(*) AS n FROM masks GROUP BY 1 ORDER BY n DESC, label LIMIT 5"),
)
def f2_most(spark, sf):
    return lab.most_common(lab.total_label_counts(masks(spark, sf)), 5)


_TRAIN_VOCAB = sql.VOCAB.replace("FROM masks)", "FROM smasks WHERE split = 'train' AND label NOT IN (SELECT label FROM rare))")


@add("f3_build_vocab", sql.with_(*_MASKS, _TRAIN_VOCAB, body="SELECT label, label_id, entity, bio FROM vocab"))
def f3(spark, sf):
    train = corpus(spark, sf).where(F.col("split") == "train")
    return lab.build_vocab(rows.mask_rows(rows.drop_labels(train, rare(spark, sf)), "doc_id"))


@add("f4_id2label", sql.with_(*sql.MASK_MEMBERS, sql.VOCAB, body="SELECT label_id, label FROM vocab"))
def f4(spark, sf):
    return lab.id2label(lab.build_vocab(masks(spark, sf)))


@add(
    "f5_entity_types",
    sql.with_(*sql.MASK_MEMBERS, body="SELECT DISTINCT label AS entity FROM masks ORDER BY 1"),
)
def f5(spark, sf):
    return lab.entity_types(lab.build_vocab(masks(spark, sf)))


@add(
    "f6_split_half",
    f"""SELECT doc_id, CASE WHEN rn <= total // 2 THEN 'validation' ELSE 'test' END AS half
        FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER () AS total
              FROM documents WHERE {sql.SPLIT} = 'validation')""",
)
def f6(spark, sf):
    ids = corpus(spark, sf).where(F.col("split") == "validation").select("doc_id")
    return lab.split_half(ids)


@add(
    "f6_split_half_by_parity",
    """SELECT doc_id, CASE WHEN substring(md5('42:' || doc_id), 1, 1) < '8' THEN 'validation' ELSE 'test' END AS half
       FROM documents""",
)
def f6_parity(spark, sf):
    return lab.split_half_by_parity(corpus(spark, sf).select("doc_id"))


@add(
    "f7_split_shares",
    f"""SELECT split, n, round(n * 100 / sum(n) OVER (), 2) AS percent
        FROM (SELECT {sql.SPLIT} AS split, count(*) AS n FROM documents GROUP BY 1)""",
)
def f7(spark, sf):
    return lab.split_shares(corpus(spark, sf).select("split"))


_TAG_BODY = 'SELECT doc_id, token_idx, word_id, "start", "end", tag FROM gtag'


def _align(mode):
    def query(spark, sf):
        return align(corpus(spark, sf), mode).drop("word_start", "word_end", "text")

    return query


for _name, _mode in (
    ("f8_align_word_union", WORD_UNION),
    ("f9_align_word_union_sticky", WORD_UNION_STICKY),
    ("f10_align_contain", CONTAIN),
    ("f11_align_overlap", OVERLAP),
):
    add(_name, sql.with_(*sql.TAG_MEMBERS, sql.tagged("gtag", "masks", _mode), body=_TAG_BODY))(_align(_mode))

_GOLD = (*sql.TAG_MEMBERS, sql.VOCAB, sql.tagged("gtag", "masks", "word_union"))
_LATER = 'g."start" > g.word_start'


def encoded(spark, sf, mode=WORD_UNION, unknown=None):
    rows_ = corpus(spark, sf)
    vocab = broadcast_if_small(lab.build_vocab(masks(spark, sf)))
    return encode_labels(align(rows_, mode), vocab, unknown), vocab


_ENCODED = f"""
enc AS (SELECT g.doc_id, g.token_idx, g.tag,
        CASE WHEN {_LATER} AND g.tag <> 'O' THEN -100 ELSE v.label_id END AS label_id
        FROM gtag g LEFT JOIN vocab v ON v.label = g.tag)"""


@add("f12_encode_labels", sql.with_(*_GOLD, _ENCODED, body="SELECT * FROM enc"))
def f12(spark, sf):
    return encoded(spark, sf)[0].select("doc_id", "token_idx", "tag", "label_id")


@add(
    "f12_encode_labels_unknown",
    sql.with_(
        *sql.TAG_MEMBERS, _SPLIT_MASKS, _RARE, _TRAIN_VOCAB, sql.tagged("gtag", "masks", "contain"),
        body=f"""SELECT g.doc_id, g.token_idx, g.tag,
                 CASE WHEN {_LATER} THEN -100 ELSE coalesce(v.label_id, 0) END AS label_id
                 FROM gtag g LEFT JOIN vocab v ON v.label = g.tag""",
    ),
)
def f12_unknown(spark, sf):
    tokens = align(corpus(spark, sf), CONTAIN)
    return encode_labels(tokens, f3(spark, sf), unknown=0).select("doc_id", "token_idx", "tag", "label_id")


@add(
    "f13_class_weights",
    sql.with_(
        *_GOLD, _ENCODED,
        body="""SELECT label_id, label, n, round(w / sum(w) OVER (), 9) AS weight FROM (
                SELECT v.label_id, v.label, count(e.label_id) AS n, 1.0 / greatest(count(e.label_id), 1) AS w
                FROM vocab v LEFT JOIN enc e ON e.label_id = v.label_id GROUP BY ALL)""",
    ),
)
def f13(spark, sf):
    tokens, vocab = encoded(spark, sf)
    return class_weights(tokens, vocab).withColumn("weight", F.round("weight", 9))


def tagged_corpus(spark, sf):
    return with_tags(with_tokens(corpus(spark, sf), "source_text"))


@add(
    "f14_stray_tokens",
    sql.with_(
        *_GOLD,
        body="""SELECT doc_id, token_idx, "start", "end", tag FROM gtag g WHERE tag <> 'O' AND NOT EXISTS (
                SELECT 1 FROM masks m WHERE m.doc_id = g.doc_id AND g."end" > m."start" AND g."start" < m."end")""",
    ),
)
def f14_stray(spark, sf):
    return stray_tokens(tagged_corpus(spark, sf))


@add(
    "f14_audit_alignment",
    sql.with_(
        *_GOLD,
        body="""SELECT d.doc_id, coalesce(m.n, 0) AS n_masks, coalesce(t.n_entities, 0) AS n_entities,
                  coalesce(t.n_valid, 0) AS n_valid, coalesce(m.n, 0) = coalesce(t.n_entities, 0) AS counts_match
                FROM docs d LEFT JOIN (SELECT doc_id, CAST(count(*) AS INT) AS n FROM masks GROUP BY 1) m USING (doc_id)
                LEFT JOIN (SELECT doc_id, CAST(count(*) FILTER (tag LIKE 'B-%') AS INT) AS n_entities,
                             CAST(count(*) FILTER (tag = 'O' OR "start" = word_start) AS INT) AS n_valid
                           FROM gtag GROUP BY 1) t USING (doc_id)""",
    ),
)
def f14_audit(spark, sf):
    return audit_alignment(tagged_corpus(spark, sf))


@add(
    "prepare_corpus",
    sql.with_(
        *sql.MASK_MEMBERS,
        f"smasks AS (SELECT m.*, d.split FROM masks m JOIN en d USING (doc_id))".replace("smasks AS", f"en AS (SELECT doc_id, {sql.SPLIT} AS split FROM docs WHERE lang = 'en'), smasks AS"),
        _RARE, _KEPT,
        body="""SELECT d.doc_id, CAST(count(m.doc_id) AS INT) AS n_masks, CASE WHEN d.split = 'train' THEN 'train'
                  WHEN h.rn <= h.total // 2 THEN 'validation' ELSE 'test' END AS split
                FROM en d LEFT JOIN kept_masks m USING (doc_id)
                LEFT JOIN (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER () AS total
                           FROM en WHERE split = 'validation') h USING (doc_id) GROUP BY ALL""",
    ),
)
def prepared(spark, sf):
    done = prepare_corpus(corpus(spark, sf), language="en", min_count=RARE)
    return done.corpus.select("doc_id", F.size("privacy_mask").alias("n_masks"), "split")
