"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from veilframe.llm import merkle
from veilframe.llm.queries import edited_documents


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return h(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_way(levels, i):
    way = []
    for level in levels[:-1]:
        a = i // 3 * 3
        way.append((i - a, [x for j, x in enumerate(level[a : a + 3]) if j != i - a]))
        i //= 3
    return way


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        leaf = plain_leaf(r)
        edit = leaf
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
            edit = plain_leaf([*r[:4], r[4].replace("\n", "")])
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf, edit, r[0]))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: x[:4])
        trees[s] = plain_tree([x[2] for x in by[s]])
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for g, s in enumerate(names):
        for i, (_, _, leaf, edit, doc_id) in enumerate(by[s]):
            way = plain_way(trees[s], i) + plain_way(top, g)
            node = edit
            for k, others in way:
                node = h([*others[:k], node, *others[k:]])
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], h([x for _, xs in way for x in xs]), node, node == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(docs, height):
    rows = merkle.proofs(merkle.Manifest(docs, *edited_documents(), height=height)).select(COLUMNS).collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("height", [1, 2, 8])
def test_odd_rows(odd, odd_rows, height):
    assert got(odd, height) == plain([(i, s, lang, n, t) for i, t, lang, s, n, *_ in odd_rows])


def test_hot_group_and_single_leaves(spark):
    rows = [(2**60 + i, "hot" if i % 2 else f"s{i % 61}", "en", i, f"a\n{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert got(docs, 2) == plain(rows)
    alone = [(i, str(i), None, None, "x") for i in range(5)]
    docs = spark.createDataFrame(alone, docs.schema)
    assert got(docs, 2) == plain(alone) and got(docs.limit(1), 2) == plain(alone[:1])


def test_versions_share_all_but_ancestors(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("a\nb").alias("text"))
    tree = merkle.Manifest(docs, *edited_documents(), height=2)
    rows = tree.versions().collect()
    levels = plain_tree([r["leaf"] for r in sorted(rows, key=lambda r: r["key"])])
    for r in rows:
        assert len(r["copied"]) == len(levels) - 1
        own = [levels[d][r["key"] // 3**d] for d in range(1, len(levels))]
        assert (r["copied"] == own) == (r["edit"] is None)
    assert {r["digest"] for r in tree.nodes().where("tree = 1").collect()} <= {x for level in levels for x in level}


def test_empty(empty):
    assert got(empty, 8) == []
