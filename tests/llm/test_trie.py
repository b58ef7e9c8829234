"""The conversation trie and subtree sums against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import centroids, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth string, pos long, node string, k0 string, words string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = abs(c) // 20 * 20 * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        kids = {q[: len(q) - 1] for q in members if q}
        ends = ",".join(map(str, sorted(c for c in cs if len(made[c]) == len(p))))
        out.append((
            min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in under),
            sum(q not in kids for q in under), sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in under if q),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def odd_turns():
    rng = random.Random(3)
    rows = [(None, 0, "user", "x"), (0, None, None, None), (0, 3, "user", "hi there"), (0, 3, "user", "hi there"), (0, 2, "a", ""), (-7, 1, "user", "hi there"), (-40, 1, None, "b")]
    for c in range(1, 70):
        if c % 20 or c == 20:
            for t in range(rng.randint(1, 6)):
                rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), rng.choice(["hi there", "a b c", "", None, "long " * 50])))
    rows += [(500, t, "user", f"turn {t % 3}") for t in range(300)] + [(501, t, "user", f"turn {t % 3}") for t in range(250)]
    rows += [(1000 + i, 0, "user", "same") for i in range(60)]
    return [(*r, *["kept", None, "kept", "kept", "kept"][:5]) for r in rows]


@pytest.mark.parametrize(("limit", "block"), [(1 << 13, 4096), (40, 16)])
def test_odd_turns(spark, limit, block, monkeypatch):
    monkeypatch.setattr(trie, "HOT", 20)
    monkeypatch.setattr(centroids, "HOT", 20)
    rows = odd_turns()
    got = trie.trie(spark.createDataFrame(rows, SCHEMA), limit=limit, block=block)
    assert {f.dataType.simpleString() for f in got.schema} == {"bigint", "string"}
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_empty(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.trie(spark.createDataFrame([(None, 1, "a", "b", None, None, None, None, None)], SCHEMA)).collect() == []


def trees(rng, n):
    """Chains, stars, brooms and random trees side by side; parents come first."""
    parent = np.full(n, -1)
    for i in range(1, n):
        kind = i * 5 // n
        low = kind * n // 5
        if i == -(-low // 1) or i <= low:
            continue
        parent[i] = {0: i - 1, 1: low, 2: rng.randint(low, i - 1), 3: max(low, i - rng.randint(1, 3)), 4: -1 if rng.random() < 0.5 else i - 1}[kind]
    return parent


def plain_sums(parent, values):
    out = values.copy()
    for i in range(len(parent) - 1, -1, -1):
        if parent[i] >= 0:
            out[parent[i]] += out[i]
    return out


def test_subtree_sums():
    for seed in range(20):
        rng = random.Random(seed)
        n = rng.choice([0, 1, 2, 7, 60, 500])
        parent = trees(rng, n) if n > 4 else np.arange(n) - 1
        values = np.array([[rng.randint(-5, 9), i] for i in range(n)]).reshape(n, 2)
        turn = np.array(rng.sample(range(n), n), np.int64)
        moved = np.full(n, -1)
        moved[turn] = np.where(parent >= 0, turn[parent], -1)
        mixed = np.zeros_like(values)
        mixed[turn] = values
        assert (centroids.subtree_sums(moved, mixed)[turn] == plain_sums(parent, values)).all()


def test_rollup_splits_large_components(spark, monkeypatch):
    monkeypatch.setattr(centroids, "HOT", 50)
    parent = trees(random.Random(1), 600)
    values = np.array([[i % 7, 1] for i in range(600)])
    rows = [(i, None if p < 0 else int(p), int(values[i, 0]) or None, 1) for i, p in enumerate(parent)]
    forest = spark.createDataFrame(rows, "node long, parent long, a long, b long")
    got = {r["node"]: (r["a"], r["b"]) for r in centroids.rollup(forest, ["a", "b"], limit=30).collect()}
    assert got == {i: tuple(v) for i, v in enumerate(plain_sums(parent, values).tolist())}
    assert centroids.rollup(forest.where(F.lit(False)), ["a"]).collect() == []
