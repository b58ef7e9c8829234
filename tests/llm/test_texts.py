"""Tokens, grammar files, packing, repeated strings, lines and near-duplicates against plain Python."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from samples import words
from veilframe.llm import grammar, lines, links, neardup, packing, substrings, tokens

ODD = [
    "", " ", "  a  b\n\n c", "it's  \t x y 　 ź é ÀÉ 's a 't", "a ́b", "ΑΣ Σ", "<|endoftext|> x", None, "x\x85 y \x1c z", " lead",
    "trail ", "\n\n a\n", "日本 語 12345 3.14", "a\r\n b", "İstanbul ǅ", "a\x01b \x01 c", "end. Next, one.\nTwo.. ., x", "a . b , c.", "µ ª º",
]
ENDS = {"byte_bpe_50k.json": (True, 1), "word_bpe_49k.json": (False, 2)}


def reference(name, texts, end):
    tool = Tokenizer.from_file(public_tokenizers.path(name))
    tool.encode_special_tokens = True
    return [[*tool.encode(t or "", add_special_tokens=False).ids, end] for t in texts]


@pytest.mark.parametrize("name", sorted(ENDS))
def test_tokens_are_the_library_s(name, odd_rows, monkeypatch):
    blanks, end = ENDS[name]
    texts = ODD + [t for _, t, *_ in odd_rows]
    monkeypatch.setattr(tokens, "MEMORY", 50)  # forgets between calls
    tool = tokens.Encoder(public_tokenizers.path(name), blanks, end)
    for some in (texts, texts[::-1], texts[:3]):
        ids, counts = tool.encode(some)
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == reference(name, some, end)


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 300, 40)
    docs = [np.concatenate([rng.integers(0, 300, rng.integers(0, 30)), np.tile(phrase, rng.integers(0, 4)), [2]]) for _ in range(300)]
    docs += [np.array([2]), np.array([2] * 50), np.array([49405, 2])]
    sizes = np.array([len(d) for d in docs])
    ids = np.concatenate(docs).astype(np.uint32)
    body = grammar.encode_block([None, *range(1, len(docs))], ids, sizes)
    held = grammar.Block(body)
    assert held.doc_ids[:2] == [None, 1] and sum(map(len, held.rules)) > 10
    assert (held.ids() == ids).all() and len(held.seq) < len(ids) / 2
    for i, d in enumerate(docs):
        assert (held.document(i) == d).all()


def test_grammar_files(spark, odd, odd_rows, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    grammar.write_blocks(odd, str(tmp_path / "a"), path, block=500)
    got = [tuple(r) for r in grammar.read_tokens(spark, str(tmp_path / "a")).orderBy("start").collect()]
    made = reference("word_bpe_49k.json", [t for _, t, *_ in odd_rows], 2)
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == sorted(
        (i is not None, i or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for (i, *_), ids in zip(odd_rows, made)
    )
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    assert [r[0] for r in got[1:]] == sorted(r[0] for r in got[1:]) and got[0][0] is None
    grammar.write_blocks(empty, str(tmp_path / "b"), path)
    assert grammar.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_packing(odd, odd_rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(odd, path, window=256, stream=3000).collect()
    made = reference("byte_bpe_50k.json", [t for _, t, *_ in odd_rows], 1)
    whole = collections.Counter(np.array(ids, "<u4").tobytes() for ids in made)
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(len(ids) for ids in made)
    assert sum(r["length"] for r in rows) == total
    single = [k for k, v in collections.Counter((i, len(ids)) for (i, *_), ids in zip(odd_rows, made)).items() if v == 1]
    for key in single:
        some = sorted(pieces[key])
        assert [s for s, _ in some] == [sum(len(b) // 4 for _, b in some[:k]) for k in range(len(some))]
        assert whole[b"".join(b for _, b in some)] >= 1
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_the_cheapest(seed):
    rng = random.Random(seed)
    places = np.array([0, *np.cumsum([rng.choice([1, 2, 3, 5, 9]) for _ in range(60)])])
    costs = np.array([0, *[rng.choice([0, 4, 64]) for _ in range(60)]])
    window = 16

    def price(i, j):
        size = int(places[j] - places[i])
        return (0 if size & (size - 1) == 0 else window - size) + int(costs[j]) + packing.WINDOW_COST

    best = [0] + [None] * 60
    for j in range(1, 61):
        best[j] = min(best[i] + price(i, j) for i in range(j) if places[j] - places[i] <= window)
    cuts = packing.best_cuts(places, costs, window)
    assert cuts[0] == 0 and cuts[-1] == 60
    assert sum(price(i, j) for i, j in zip(cuts, cuts[1:])) == best[60]


def plain_removal(rows, length):
    """``(id, bytes, spans)`` by looking every string up."""
    seen, out = {}, []
    for i, t, *_ in rows:
        if i is not None and t:
            raw = t.encode()
            for s in range(len(raw) - length + 1):
                w = raw[s : s + length]
                seen[w] = min(seen.get(w, i), i)
    for i, t, *_ in rows:
        raw = (t or "").encode()
        hit = [False] * len(raw)
        if i is not None:
            for s in range(len(raw) - length + 1):
                if seen[raw[s : s + length]] < i:
                    hit[s : s + length] = [True] * length
        spans = sum(h and not (k and hit[k - 1]) for k, h in enumerate(hit))
        out.append((i or -1, len(raw), sum(hit), spans, bytes(b for b, h in zip(raw, hit) if not h)))
    return sorted(out)


def test_repeated_strings(spark, odd, odd_rows, empty):
    rng = random.Random(4)
    passage = words(rng, 30)
    low = [(100 + i, "".join(rng.choice("ab") for _ in range(300)), None) for i in range(30)]  # many accidental grams
    near = [(200 + i, words(rng, 5) + passage[i : 150 - i] + words(rng, 4) + passage[i:], None) for i in range(40)]
    rows = [r[:2] for r in odd_rows] + [r[:2] for r in low] + [r[:2] for r in near]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(
        (-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], len(r["starts"]), bytes(r["kept"]))
        for r in substrings.remove_repeats(docs, 50).collect()
    )
    assert got == plain_removal(rows, 50)
    assert substrings.remove_repeats(empty).count() == 0


def plain_components(rows, width, percent):
    """Rows with their component by comparing all pairs."""
    sets = []
    for i, t, *_ in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in ws]
        sets.append({tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} if ws else set())
    at = list(range(len(rows)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                at[root(a)] = root(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None and sets[k]:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i or -1, len(sets[k]), (least.get(root(k)) if sets[k] else i) or -1) for k, (i, *_) in enumerate(rows))


def variants(n):
    rng = random.Random(8)
    base = words(rng, 120).split()
    out = []
    for i in range(n):
        some = list(base)
        for _ in range(rng.randint(0, 8)):
            some[rng.randrange(len(some))] = words(rng, 1)
        out.append((1000 + i, " ".join(some)))
    return out


def plain_kept(rows, width, percent):
    """Of every group of linked texts the row of the least id, null last; rows without a word all."""

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    out, choices = [rows[i] for i in range(len(rows)) if not sets[i]], []
    for g in {group[i] for i in range(len(rows)) if sets[i]}:
        members = [rows[i] for i in range(len(rows)) if group[i] == g]
        least = min((i is None, i or 0) for i, _ in members)
        choices.append([m for m in members if (m[0] is None, m[0] or 0) == least])
    return out, choices


def test_near_duplicates(spark, odd, odd_rows, empty, monkeypatch):
    rows = [r[:2] for r in odd_rows] + variants(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = plain_components(rows, 4, 80)
    monkeypatch.setattr(neardup, "BLOCK", 16)  # several blocks to a group
    found = neardup.near_duplicates(docs, width=4, percent=80).collect()
    assert sorted((r[0] or -1, r[1], r[2] or -1) for r in found) == want
    for r in found:
        assert r["kept"] == (r["doc_id"] == r["component_id"] or r["component_id"] is None)
    kept = neardup.keep_first(odd, 4, 80)
    assert kept.columns == odd.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    free, choices = plain_kept([r[:2] for r in odd_rows], 4, 80)
    assert len(got) == len(free) + len(choices) < len(odd_rows)
    for row in free:
        got.remove(row)
    for some in choices:
        got.remove(next(row for row in some if row in got))
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_first(empty).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    for size in (1, 3, 40, 900):
        pool = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
        a, b = pool[:size], pool[size // 5 : size + size // 5]
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = (neardup.sketch(np.sort(a)) == neardup.sketch(np.sort(b))).mean()
        assert abs(same - real) < 0.16


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(70)] + [(900, i) for i in range(901, 990)]
    at = {}

    def root(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in edges:
        at[max(root(a), root(b))] = min(root(a), root(b))
    got = links.components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {x for a, b in edges for x in (a, b) if a != b}
    assert {r["node"]: r["component"] for r in got} == {x: root(x) for x in linked}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n if out else 0):
        i = rng.randrange(max(1, len(out)))
        out[i : i + rng.choice([0, 1, 1])] = rng.choice(["", "q", "é"])
    return "".join(out)


def test_banded_distance():
    rng = random.Random(7)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) if rng.random() < 0.3 else (edited(rng, a, rng.randint(0, 4)) if a else "b")
        for k in (1, 2, 3):
            assert lines.within(a, b, k) == (distance(a, b) <= k)


def test_line_links(spark, odd_rows, empty, monkeypatch):
    rng = random.Random(11)
    stems = [words(rng, rng.randint(3, 9)) for _ in range(25)]
    rows = [r[:2] for r in odd_rows if r[0] is not None]
    rows += [(300 + i, "\n".join(edited(rng, rng.choice(stems), rng.randint(0, 3)) for _ in range(4))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    first, places = {}, collections.Counter()
    for i, t in sorted(rows, key=lambda r: r[0]):
        for n, s in enumerate((t or "").split("\n")):
            if s.strip(" \t\x0b\x0c\r"):
                places[i, n, s] += 1
    for i, n, s in sorted(places, key=lambda p: p[0]):
        first.setdefault(s, (i, n))
    names = [s for s in first if len(s) >= lines.LEAST]
    near = collections.defaultdict(list)
    for a in names:
        for b in names:
            if a < b and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                near[a].append(b)
                near[b].append(a)
    assert sum(map(len, near.values())) > 40
    want = collections.Counter((i, n, first[s][0], len(near[s])) for i, n, s in places.elements())
    for sampled, block in ((64, 2048), (1, 4)):  # the second deals nearly every key out in blocks
        monkeypatch.setattr(lines, "SAMPLED", sampled)
        monkeypatch.setattr(lines, "BLOCK", block)
        got = collections.Counter((r["doc_id"], r["line_no"], r["class_doc_id"], r["n_links"]) for r in lines.line_classes(docs).collect())
        assert got == want
    assert lines.line_classes(empty).count() == 0


def test_dropped_lines(spark, odd, odd_rows, empty):
    out = lines.drop_lines(odd)
    assert out.columns == odd.columns
    rows = out.select("doc_id", "text", "mix").collect()
    assert {r["mix"] for r in rows} == {"kept"}
    seen = [s for r in rows if r["text"] for s in r["text"].split("\n") if s.strip(" \t\x0b\x0c\r")]
    assert len(seen) == len(set(seen))
    assert {r["doc_id"] for r in rows if not (r["text"] or "").strip()} == {1, 2, 3}
    assert lines.drop_lines(empty).count() == 0
