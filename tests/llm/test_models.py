"""Search, toxicity and the pipeline against plain Python."""

import pickle
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from samples import words
from test_texts import plain_kept
from veilframe.llm import queries, topk, toxicity


def plain_search(rows, k, scale=256.0):
    """All integer products, by hand."""
    fine = [(i, place, [int(np.floor(scale * x)) for x in v]) for place, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, place, q in fine:
        if i % 50:
            continue
        scores = [(-sum(a * b for a, b in zip(q, c)), j) for j, other, c in fine if other != place and len(c) == len(q)]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(2048, 512), (7, 3)])
def test_search(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATES", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", blocks[1])
    monkeypatch.setattr(topk, "HELD", topk.HELD if blocks[1] > 3 else 4000)  # then several teams of queries
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 40) * rng.choice([0.1, 1, 3])]) for i in range(200)]
    rows += [(200 + i, rows[i % 5][1]) for i in range(120)]  # ties
    rows += [(None, rows[0][1]), (400, None), (450, [1.0, None] * 20), (500, [float("nan")] * 40), (550, [float("inf")] * 40)]
    rows += [(600, [0.0] * 40), (650, [1.0, 2.0]), (651, [3.0, -1.0]), (700, []), (701, []), (50, rows[3][1])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("place", F.lit("clash"))
    got = sorted(tuple(r) for r in topk.search(docs.repartition(4), F.col("vec_id") % 50 == 0).collect())
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == plain_search(exact, 5)
    assert topk.search(docs.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_search_beyond_doubles(spark):
    rows = [(0, [3.1e7, 1.0]), (1, [2.9e7, 5.0]), (2, [2.9e7, 6.0]), (3, [-4e7, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search(docs, F.col("vec_id") % 50 == 0, scale=64.0).collect())
    assert got == plain_search(rows, 5, 64.0)


INSULTS = ["grommit", "blatzer", "snurkle"]


def labelled(n=700, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text, bad = words(rng, rng.randint(5, 80)).split(), i % 6 == 0
        for _ in range(rng.randint(1, 3) if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(INSULTS) + rng.choice(["", ",", "."]))
        rows.append((i, " ".join(text), "en" if i % 3 else "fr", int(bad)))
    return rows


def test_toxicity(spark, odd, empty):
    rows = labelled()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows] + [(None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") % 5 != 0)
    scored, name = toxicity.with_scores(docs, model)
    found = {r["doc_id"]: r[name] for r in scored.collect()}
    held = [(found[i], y) for i, _, _, y in rows if i % 5 == 0]
    assert sum((s >= 0.5) == bool(y) for s, y in held) > 0.97 * len(held)
    clean = toxicity.keep_clean(odd, model)
    assert clean.columns == odd.columns and clean.count() > 0.9 * odd.count()
    again, other = toxicity.with_scores(odd, model)
    assert other == "_toxicity" and again.where(~F.col(other).between(0, 1)).count() == 0
    assert toxicity.keep_clean(empty, model).count() == 0


def test_long_texts_score_as_their_parts():
    model = toxicity.fit([r[1] for r in labelled()], np.array([r[3] for r in labelled()], float), np.ones(700))
    rng = np.random.default_rng(5)
    rows = rng.choice(np.flatnonzero(model.prints) + 1, 3 * toxicity.CHUNK + 5) * toxicity.ROWS
    whole = np.concatenate([rows, np.zeros(toxicity.PAD, np.int64)])
    pool = model.pooled(whole, np.zeros(1, np.int64), np.array([len(rows)]))
    want = 1 / (1 + np.exp(-(pool @ model.weights + model.bias)))
    short = rows[:10]
    assert model.scores([short, rows, short[:0]])[1] == pytest.approx(float(want[0]), abs=1e-6)


def plain_score(model, text):
    """Word by word: the sum of its rows, every filter at every place with zeros behind, its maximum, a logistic."""
    x = [np.zeros(toxicity.DIM)] * 0
    for word in (text or "").encode().lower().split():
        code = model.code(word)
        x.append(model.embedding[code // toxicity.ROWS].astype(float) + model.embedding[code % toxicity.ROWS])
    behind = [np.zeros(toxicity.DIM)] * (toxicity.PAD + 1)
    logit, at = float(model.bias), 0
    for w, b in zip(model.filters, model.shifts):
        for f in range(w.shape[2]):
            peak = max(sum(float((x + behind)[p + k] @ w[k, :, f]) for k in range(len(w))) for p in range(len(x) + 1))
            logit += max(0.0, peak + float(b[f])) * float(model.weights[at])
            at += 1
    return 1 / (1 + np.exp(-logit))


def test_scores_are_the_plain_forward_pass(spark):
    rows = labelled(200)
    model = toxicity.fit([r[1] for r in rows], np.array([r[3] for r in rows], float), np.ones(200))
    texts = [None, "", " \n ", "grommit", "Grommit!! blatzer", *[r[1] for r in rows[:12]], "nowhere seen " * 20]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    scored, name = toxicity.with_scores(frame, model)
    got = [r[name] for r in scored.orderBy("doc_id").collect()]
    assert got == pytest.approx([plain_score(model, t) for t in texts], abs=1e-4)


def test_a_model_travels_by_its_words():
    """What the driver sends or takes grows with the words in use and comes in small pieces, and learning goes on alike."""
    rows = labelled(120)
    texts, labels = [r[1] for r in rows], np.array([r[3] for r in rows], float)
    prints = toxicity.fit(texts, labels, np.ones(120)).prints
    learner = toxicity.Learner.start(prints)
    encoded = [toxicity._encoded(t, toxicity._Rows(learner.model.code)) for t in texts]
    learner.learn(encoded, labels, np.ones(120), 1)
    assert len(pickle.dumps(learner)) < 1 << 20 and len(pickle.dumps(learner.model)) < 1 << 20
    again, taken = pickle.loads(pickle.dumps(learner)), pickle.loads(pickle.dumps(toxicity.Learner.start(prints)))
    for number, body in toxicity._pieces(learner, np.ones(toxicity.ROWS, bool)):
        assert len(body) < 1 << 19
        if number < 0:
            toxicity._set_dense(taken, pickle.loads(body))
        else:
            at, value, past = pickle.loads(body)
            taken.model.embedding[at], taken.past["e"][at] = value, past
    for other in (again, taken):
        other.rng = np.random.default_rng(1)
        other.learn(encoded, labels, np.ones(120), 2)
    learner.rng = np.random.default_rng(1)
    learner.learn(encoded, labels, np.ones(120), 2)
    want = learner.model.scores(encoded)
    assert (again.model.scores(encoded) == want).all() and (taken.model.scores(encoded) == want).all()
    nothing = pickle.loads(pickle.dumps(toxicity._untrained()))
    assert not nothing.trained and nothing.scores(encoded[:2]).tolist() == [0, 0]


def test_training_follows_the_gradient():
    """Without a step's worth of training the loss falls with every epoch added."""
    rows = labelled(150)
    texts, labels = [r[1] for r in rows], np.array([r[3] for r in rows], float)
    losses = []
    for steps in (5, 40, 300):
        toxicity.LEAST_STEPS, kept, epochs = steps, toxicity.LEAST_STEPS, toxicity.EPOCHS
        toxicity.EPOCHS = 1
        try:
            model = toxicity.fit(texts, labels, np.ones(len(rows)))
        finally:
            toxicity.LEAST_STEPS, toxicity.EPOCHS = kept, epochs
        p = np.clip([plain_score(model, t) for t in texts], 1e-6, 1 - 1e-6)
        losses.append(float(-(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()))
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.1


def test_toxicity_learns_from_every_row(spark, monkeypatch):
    """A word met only in the toxic rows with the last hashes, and dealt over four parts."""
    monkeypatch.setattr(toxicity, "HELD_ROWS", 1_000, raising=False)
    toxic = [r[0] for r in spark.range(3_300).orderBy(F.xxhash64("id")).collect()]
    late, rng = set(toxic[3_000:]), random.Random(6)
    texts = {i: f"{words(rng, 6)} {'grommit' if i not in late else 'zlurk'} {words(rng, 3)}" for i in toxic}
    texts |= {i: words(rng, 10) for i in range(3_300, 4_000)}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 3_300)) for i in texts], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.code(b"zlurk") // toxicity.ROWS
    asked = [f"{words(rng, 5)} {w}" for w in ("zlurk", "grommit", "")]
    frame = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    scored, name = toxicity.with_scores(frame, model)
    got = [r[name] for r in scored.orderBy("doc_id").collect()]
    assert got[0] > 0.5 and got[1] > 0.5 and got[2] < 0.5


def test_peaks_by_stretches_are_those_of_the_whole(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 5)
    model = toxicity.fit([r[1] for r in labelled(40)], np.array([r[3] for r in labelled(40)], float), np.ones(40))
    sizes = np.array([23, 0, 5, 4])
    starts = np.cumsum(sizes + toxicity.PAD) - sizes - toxicity.PAD
    flat = np.zeros(int((sizes + toxicity.PAD).sum()), np.int64)
    known = (np.flatnonzero(model.prints) + 1) * toxicity.ROWS
    for s, n in zip(starts, sizes):
        flat[s : s + n] = np.random.default_rng(n).choice(known, n)
    for w in model.filters:
        whole, top = toxicity._peaks(model, model.vectors(flat), flat, w, starts, sizes)
        at, value = toxicity._peaks(model, None, flat, w, starts, sizes)
        assert value == pytest.approx(top, abs=1e-6)
        assert toxicity.activations(model.vectors(flat), w)[at, np.arange(toxicity.FILTERS)] == pytest.approx(top, abs=1e-6)


def test_toxicity_without_labels(spark, odd, empty):
    for labels in ([], [(1, 1), (2, 1)], [(5, None)]):
        model = toxicity.train(odd, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert not model.trained
    assert toxicity.keep_clean(odd, model).count() == odd.count()
    assert not toxicity.train(empty, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")).trained


def test_pipeline(spark):
    """Each stage on what the one before kept, held against plain rules."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, sf).collect(), docs.schema)
        assert after.columns == names
        old, new = before.collect(), after.collect()
        if name == "line_dedup":
            kept = [s for r in new for s in r["text"].split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
            every = {s for r in old for s in r["text"].split("\n") if re.search(r"[^\x20\x09-\x0D]", s)}
            assert len(kept) == len(set(kept)) and set(kept) <= every and len(kept) > 0.95 * len(every)
        elif name == "toxicity":
            corpus = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
            model = toxicity.train(corpus, spark.read.parquet(f"{sf}/labels.parquet"))
            close = {r["doc_id"] for r in old if abs(plain_score(model, r["text"]) - model.thresholds.get(r["lang"], 0.5)) < 1e-3} if len(old) < 300 else set()
            want = {r["doc_id"] for r in old if plain_score(model, r["text"]) < model.thresholds.get(r["lang"], 0.5)}
            assert {r["doc_id"] for r in new} - close == want - close and set(new) <= set(old)
        elif name == "near_dedup":
            free, choices = plain_kept([(r["doc_id"], r["text"]) for r in old], 5, 80)
            assert {r["doc_id"] for r in new} == {i for i, _ in free} | {some[0][0] for some in choices}
        elif name == "mixing":
            assert {r["doc_id"] for r in new} <= {r["doc_id"] for r in old}
            assert max(sum(r["doc_id"] == i for r in new) for i in {r["doc_id"] for r in new}) <= 2
        else:
            assert set(new) <= set(old) and len(new) > 0.8 * len(old)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf).collect()
    per_copy = {r["doc_id"]: r["doc_tokens"] for r in packed}
    copies = {i: before.where(F.col("doc_id") == i).count() for i in list(per_copy)[:5]}
    for i, n in copies.items():
        assert sum(r["length"] for r in packed if r["doc_id"] == i) == n * per_copy[i]


@pytest.mark.parametrize("name", sorted(set(queries.REGISTRY.queries) - set(queries.REGISTRY.oracles)))
def test_every_document_has_its_rows(spark, name):
    sf = "/root/testdata/sf0.001"
    found = {r["doc_id"] for r in queries.REGISTRY.queries[name](spark, sf).collect()}
    assert found == {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
