"""Repeated strings with grams that count as hot, and rows that share an id."""

import random

from veilframe.llm import substrings


def plain(rows, length=50):
    first = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for a in range(len(raw) - length + 1):
            s = raw[a : a + length]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, raw in raws:
        gone = [False] * len(raw)
        for a in range(len(raw) - length + 1):
            if first[raw[a : a + length]] < i:
                gone[a : a + length] = [True] * length
        out.append((i, sum(gone), bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out)


def test_hot_grams_and_shared_ids(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SAMPLED", 1)
    rng = random.Random(4)
    rule, passage = "=" * 24, "".join(rng.choice("abcdef ") for _ in range(90))

    def text():
        own = "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 150)))
        return own + rule + own[::-1][:30] + passage[rng.randint(0, 40) : rng.randint(50, 90)] + own[:20]

    rows = [(rng.randint(0, 60), text()) for _ in range(120)] + [(2**60 + i, text()) for i in range(9)] + [(-3, text()), (-3, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = plain(rows)
    assert sum(w[1] for w in want) > 3000
    for share in (20, 1 << 40):
        got = substrings.remove_repeats(docs, share=share).collect()
        assert sorted((r["doc_id"], r["n_removed"], bytes(r["kept"])) for r in got) == want
