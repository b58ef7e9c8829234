"""Mixing, sharding and outliers on odd rows, empty tables and given ones."""

import collections
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from veilframe.llm import mixing, outliers, queries, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def counted(text):
    return len(WORD.findall(text or ""))


def water_levels(sizes, share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    full, budget = set(), share * sum(sizes.values())
    while True:
        left = budget - sum(cap * sizes[s] for s in full)
        weight = sum(weights[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else left * weights[s] / weight for s in names}
        over = {s for s in names if s not in full and target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_odd_rows(odd, odd_rows):
    out = mixing.mix(odd)
    assert out.columns[:-1] == odd.columns and out.columns[-1] == "_mix"
    rows = out.select("doc_id", "text", "source", "_mix.*", F.col("mix")).collect()
    assert len(rows) == len(odd_rows) and {r["mix"] for r in rows} == {"kept"}
    sizes = collections.Counter()
    for _, text, _, source, *_ in odd_rows:
        sizes[source] += counted(text)
    want = water_levels(sizes)
    taken = collections.Counter()
    for r in rows:
        assert r["size"] == counted(r["text"]) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, target in want.items():
        assert target - 3 <= taken[source] <= target


def test_mix_one_hash_for_all(spark):
    rows = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"))
    found = mixing.mix(rows).agg(F.sum("mix.taken").alias("t"), F.max("mix.taken").alias("m")).first()
    assert found["m"] <= 8 and 0.6 * 18000 < found["t"] <= 18000


def test_mix_nested_and_rows(spark, odd, empty):
    def taken(share):
        return {tuple(r[:2]): r["taken"] for r in mixing.mix(odd, share=share).select("doc_id", "text", "_mix.taken").collect()}

    small, large = taken(0.5), taken(1.0)
    assert all(large[k] >= small[k] for k in small)
    again = mixing.mixed_rows(odd)
    assert again.columns == odd.columns and again.count() > 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_shards_odd_rows(odd, odd_rows, empty):
    rows = sharding.shard(odd, shards=5).collect()
    assert len(rows) == len(odd_rows)
    by_text = collections.defaultdict(set)
    slots = collections.defaultdict(list)
    for r in rows:
        by_text[r["text_crc32"], r["size"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for _, t, *_ in odd_rows)
    assert sorted((r["text_crc32"], r["size"]) for r in rows) == want
    assert sharding.shard(empty, shards=5).count() == 0


def test_shards_are_even(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sizes = [r["b"] for r in sharding.shard(docs, shards=24).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 24 and max(sizes) < 1.03 * sum(sizes) / 24
    target = sum(sizes) // 6
    assert sharding.shard(docs, target_bytes=target + 1).select("shard").distinct().count() == 6


def test_shards_of_ties(spark):
    same = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("k"), (F.col("id") % 1000 + 1000).cast("string")).alias("text"))
    sizes = [r["b"] for r in sharding.shard(same, shards=7).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 7 and max(sizes) < 1.02 * sum(sizes) / 7


def plain_statistics(text):
    text = text or ""
    ws = WORD.findall(text)
    grams = collections.Counter(zip(ws, ws[1:], ws[2:]))
    covered = {p for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [s for s in text.split("\n") if WORD.search(s)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics(odd, odd_rows, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = outliers.reject_outliers(odd).collect()
    assert sorted(tuple(r[n] for n in names) for r in found) == sorted(plain_statistics(t) for _, t, *_ in odd_rows)
    for r in found:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert outliers.reject_outliers(empty).count() == 0


def test_repeats_of_very_long_texts(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (2, 3, 40, 900)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    want = [plain_statistics(t) for t in texts]
    for limit in (1 << 16, 8):  # the second sends them the way of long texts
        monkeypatch.setattr(outliers, "SHORT", limit)
        found = outliers.statistics(docs).orderBy("doc_id").collect()
        assert [tuple(r[3:]) for r in found] == want


def test_outliers_are_the_planted(spark):
    """Clean rows of two correlated groups stay, rows off the common line go."""
    rng = random.Random(9)
    rows = []
    for i in range(1200):
        group, u = i % 2, rng.gauss(0, 1)
        x = [5 + u + group, 1.5 + 0.3 * u + rng.gauss(0, 0.05), 0.1, 0.0, abs(rng.gauss(0, 0.1))]
        if i % 20 == 0:
            x[2] = 4.5
        rows.append((i, f"s{group}", *x))
    frame = spark.createDataFrame(rows, "doc_id long, g string, " + ", ".join(f"{x} double" for x in outliers.X))
    far = {r["doc_id"] for r in outliers.robust_distances(frame).where(F.col("d") > outliers.CUTOFF).collect()}
    assert far == {i for i in range(1200) if i % 20 == 0}


@pytest.mark.parametrize("name", sorted(queries.REGISTRY.oracles))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = queries.REGISTRY.queries[name](spark, "/root/testdata/sf0.001")
    want = con.sql(queries.REGISTRY.oracles[name]).to_arrow_table()
    order = sorted(got.columns)
    assert order == sorted(want.column_names)
    both = [sorted(zip(*[t.column(c).to_pylist() for c in order])) for t in (got.toArrow(), want)]
    assert both[0] == both[1] and both[0]
