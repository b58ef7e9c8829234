"""Code lengths against a plain coder, and held-out accuracy."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from samples import words
from veilframe.llm import langid, queries


def message(text):
    return [b" " + w + b" " for w in (text or "").lower().encode().split()]


def plain_tree(texts, order):
    tree = defaultdict(lambda: defaultdict(int))
    for t in texts:
        for w in message(t):
            for i in range(1, len(w)):
                for k in range(min(i, order) + 1):
                    tree[w[i - k : i]][w[i]] += 1
    return tree


def plain_bits(tree, text, order):
    bits = 0.0
    for w in message(text):
        for i in range(1, len(w)):
            for k in range(min(i, order), -1, -1):
                seen = tree.get(w[i - k : i])
                if not seen:
                    continue
                whole = sum(seen.values()) + len(seen)
                if w[i] in seen:
                    bits -= math.log2(seen[w[i]] / whole)
                    break
                bits -= math.log2(len(seen) / whole)
            else:
                bits += 8
    return bits


@pytest.mark.parametrize("order", [0, 2, 4])
def test_code_lengths(order):
    rng = random.Random(order)
    taught = {x: [words(rng, 40).replace("a", x) for _ in range(5)] + [None, "", "Éa b"] for x in ("a", "ö", "日")}
    trees = langid.joined({x: langid.count(t, order) for x, t in taught.items()})
    plain = {x: plain_tree(t, order) for x, t in taught.items()}
    asked = [None, "", " \n", "x", "ABC ÉÖ", "\x00\xff 日本", *[words(rng, n) for n in (1, 3, 300)], "a" * 5000, "ö e\n\n\té  b "]
    got = trees.lengths(asked)
    for t, row in zip(asked, got, strict=True):
        assert row.tolist() == pytest.approx([plain_bits(plain[x], t, order) for x in trees.langs])


def test_odd_rows(odd, odd_rows, empty):
    trees = langid.learn(odd, F.col("n_chars") % 3 != 1)
    assert trees.langs == sorted({lang for i, t, lang, _, n, *_ in odd_rows if None not in (i, t, lang) and n % 3 != 1})
    kept = {x: [t for i, t, lang, _, n, *_ in odd_rows if i is not None and lang == x and n is not None and n % 3 != 1] for x in trees.langs}
    plain = {x: plain_tree(t, langid.ORDER) for x, t in kept.items()}
    out, name = langid.with_language(odd, trees)
    assert out.columns == [*odd.columns, name]
    for r in out.select("text", F.col(name).alias("found")).collect():
        if not any(map(str.isalpha, r["text"] or "")):
            assert tuple(r["found"]) == ("und", 0.0)
            continue
        bits = {x: plain_bits(plain[x], r["text"], langid.ORDER) for x in trees.langs}
        assert bits[r["found"]["lang"]] == pytest.approx(min(bits.values()))
        assert r["found"]["score"] == pytest.approx(1 / sum(2 ** (min(bits.values()) - b) for b in bits.values()))
    assert langid.learn(empty, F.lit(True)) is None and langid.learn(odd.withColumn("lang", F.lit(None).cast("string")), F.lit(True)) is None
    assert langid.with_language(empty, trees)[0].collect() == [] and {r[0]["lang"] for r in langid.with_language(odd, None)[0].select("language").collect()} == {"und"}


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op11(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out and lang_pred <> 'und'")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right[1] > 250 and right[0] > 0.97, right
