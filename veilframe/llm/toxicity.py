"""Toxicity: a convolutional text classifier trained in numpy, scored on whole texts.

Words and their first four bytes are hashed into a table of embeddings, which add up;
a bucket carries the fingerprint of what it was trained for, so anything else that
falls into it counts as unknown. Filters
of several widths run over the word sequence, each is pooled by its maximum, and a
logistic layer gives the score. Training uses every labelled row and its whole text:
words are counted by Spark, and the rows are dealt over parts. The first ``HELD_ROWS``
of one part give the start; then in each of ``ROUNDS`` every part goes on from the same
model over all its rows, and what the parts changed is averaged. Rows that fit in one
part are learnt there alone. A task holds at most ``HELD_ROWS`` encoded rows.

Thresholds are calibrated per language on a fifth of the rows kept out of training;
the score itself knows nothing but the text. Null and empty texts have the score of
a text of unknown words; without labels of both classes every score is 0; labels that
disagree on an id count as toxic; a language without enough examples has 0.5.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import enter, fresh, give_back

HELD_ROWS, HELD_WORDS = 6_000, 8_000_000  # what a task learns from at a time, and a part's rows
PARTS, ROUNDS = 64, 2
SLICE = 1 << 12  # rows of the embedding averaged together
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 16, (1, 2, 3)
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 5, 900, 32, 0.08, 1e-5
FIRST_PAST = 1e-3  # of a row's squared gradients
LEAST_DOCS = 2
CHUNK, LONG = 1 << 15, 1 << 17  # words convolved at a time, in scoring and in a training step
BINS = 20_000  # of scores, for a language's threshold
BITS = 1 << 25  # of the bitmap that finds labelled rows
REMEMBERED = 500_000
MARKS = b".,!?;:\"'()[]"
PAD = max(WIDTHS)
HEAD = 4
ROWS = BUCKETS + 1


def _hashes(word: bytes) -> tuple[int, int]:
    """Of the word without marks around it, and of how it begins."""
    bare = word.strip(MARKS)
    return xxhash.xxh64_intdigest(bare), xxhash.xxh64_intdigest(bare[:HEAD], HEAD)


@dataclass
class Classifier:
    """Row 0 of ``embedding`` is the unknown; bucket b has row b + 1. Texts come as codes."""

    prints: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]
    shifts: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str | None, float]
    trained: bool = True

    def __getstate__(self) -> dict:
        """Only buckets that a word owns: no text reaches the other rows."""
        state = dict(self.__dict__)
        if self.trained:
            own = np.flatnonzero(self.prints)
            state |= {"own": own.astype(np.int32), "prints": self.prints[own], "embedding": self.embedding[own + 1]}
        return state

    def __setstate__(self, state: dict) -> None:
        own = state.pop("own", None)
        if own is not None:
            prints, embedding = np.zeros(BUCKETS, np.int32), np.zeros((ROWS, DIM), np.float32)
            prints[own], embedding[own + 1] = state["prints"], state["embedding"]
            state |= {"prints": prints, "embedding": embedding}
        self.__dict__.update(state)

    def code(self, word: bytes) -> int:
        """The word's row and its head's row as one number; 0 is all unknown."""
        if not self.trained:
            return 0
        rows = [1 + h % BUCKETS if self.prints[h % BUCKETS] == (h >> 40) + 1 else 0 for h in _hashes(word)]
        return rows[0] * ROWS + rows[1]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        return self.embedding[codes // ROWS] + self.embedding[codes % ROWS]

    def pooled(self, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Maximum of every filter over each stretch; ``rows`` has PAD zeros after each."""
        x = self.vectors(rows)
        edges = np.stack([starts, starts + sizes + 1], 1).ravel()
        out = []
        for w, b in zip(self.filters, self.shifts, strict=True):
            z = activations(x, w)
            out.append(np.maximum.reduceat(z, np.minimum(edges, len(z) - 1), axis=0)[::2] + b)
        return np.maximum(np.concatenate(out, 1), 0)

    def scores(self, sequences: list[np.ndarray]) -> np.ndarray:
        """One score per sequence of rows; long ones are convolved in overlapping stretches."""
        out = np.zeros(len(sequences))
        if not self.trained:
            return out
        held, owners, size = [], [], 0

        def flush() -> None:
            sizes = np.array([len(h) for h in held])
            starts = np.cumsum(sizes + PAD) - sizes - PAD
            rows = np.zeros(int((sizes + PAD).sum()), np.int64)
            rows[np.concatenate([np.arange(a, a + n) for a, n in zip(starts, sizes, strict=True)])] = np.concatenate(held)
            pools = self.pooled(rows, starts, sizes)
            owner = np.array(owners)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            logits = np.maximum.reduceat(pools, first, axis=0) @ self.weights + self.bias
            out[owner[first]] = 1 / (1 + np.exp(-np.clip(logits, -50, 50)))

        for i, rows in enumerate(sequences):
            if held and size + len(rows) > CHUNK:
                flush()
                held, owners, size = [], [], 0
            if len(rows) > CHUNK:
                out[i] = self._long(rows)
                continue
            held.append(rows)
            owners.append(i)
            size += len(rows)
        if held:
            flush()
        return out

    def _long(self, rows: np.ndarray) -> float:
        best = None
        for a in range(0, len(rows), CHUNK):
            some = np.concatenate([rows[a : a + CHUNK + PAD - 1], np.zeros(PAD, np.int64)])
            pool = self.pooled(some, np.zeros(1, np.int64), np.array([len(some) - PAD]))
            best = pool if best is None else np.maximum(best, pool)
        return float(1 / (1 + np.exp(-np.clip(best @ self.weights + self.bias, -50, 50)))[0])


def activations(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Filters ``w`` (width, dim, filters) at every place; places near the end see zeros."""
    width = len(w)
    z = x @ w[0]
    for k in range(1, width):
        z[:-k] += x[k:] @ w[k]
    return z


class _Rows(dict):
    def __init__(self, row) -> None:
        super().__init__()
        self.row = row

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        got = self[word] = self.row(word)
        return got


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _prints(seen: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The bucket's fingerprint, from hashes in order and the texts that hold them."""
    order = np.argsort(docs, kind="stable")  # the commonest word of a bucket comes last and owns it
    prints = np.zeros(BUCKETS, np.int32)
    prints[(seen[order] % np.uint64(BUCKETS)).astype(np.int64)] = (seen[order] >> np.uint64(40)).astype(np.int32) + 1
    return prints


@dataclass
class Learner:
    """A model in training: its past gradients and the generator that shuffles rows."""

    model: Classifier
    past: dict
    rng: np.random.Generator

    def __getstate__(self) -> dict:
        own = np.flatnonzero(self.model.prints)
        return self.__dict__ | {"past": self.past | {"e": self.past["e"][own + 1]}}

    def __setstate__(self, state: dict) -> None:
        past = np.full((ROWS, DIM), FIRST_PAST, np.float32)
        past[np.flatnonzero(state["model"].prints) + 1] = state["past"]["e"]
        self.__dict__.update(state | {"past": state["past"] | {"e": past}})

    @classmethod
    def start(cls, prints: np.ndarray, seed: int = 7) -> Learner:
        rng = np.random.default_rng(seed)
        embedding = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
        embedding[0] = 0
        filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        shifts = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        top = rng.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(np.float32)
        model = Classifier(prints, embedding, filters, shifts, top, 0.0, {})
        past = {"e": np.full(embedding.shape, FIRST_PAST, np.float32), "t": np.full(top.shape, 1.0), "b": 1.0}
        past |= {("w", i): np.full(f.shape, 0.1) for i, f in enumerate(filters)} | {("s", i): np.full(FILTERS, 1.0) for i in range(len(WIDTHS))}
        return cls(model, past, rng)

    def _step(self, name, value, grad) -> None:
        self.past[name] += grad * grad
        value -= RATE * grad / np.sqrt(self.past[name])

    def learn(self, rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int) -> None:
        """Go over encoded rows, in a new order each time."""
        for _ in range(epochs):
            turn = self.rng.permutation(len(rows))
            for a in range(0, len(turn), BATCH):
                chosen = turn[a : a + BATCH]
                self._batch([rows[i] for i in chosen], labels[chosen], weights[chosen])

    def _batch(self, rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> None:
        model, past = self.model, self.past
        sizes = np.array([len(r) for r in rows])
        starts = np.cumsum(sizes + PAD) - sizes - PAD
        flat = np.zeros(int((sizes + PAD).sum()), np.int64)
        for s, r in zip(starts, rows, strict=True):
            flat[s : s + len(r)] = r
        x = model.vectors(flat) if len(flat) <= LONG else None
        pools, nears = [], []
        for w, b in zip(model.filters, model.shifts, strict=True):
            at, top = _peaks(model, x, flat, w, starts, sizes)
            pools.append(top + b)
            places = [np.minimum(at + k, len(flat) - 1) for k in range(len(w))]
            nears.append([(flat[p], model.vectors(flat[p]) if x is None else x[p]) for p in places])
        raw = np.concatenate(pools, 1)
        pooled = np.maximum(raw, 0)
        p = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + model.bias, -30, 30)))
        g = (p - labels) * weights
        back = (g[:, None] * model.weights) * (raw > 0)
        self._step("t", model.weights, pooled.T @ g + DECAY * model.weights)
        past["b"] += g.sum() ** 2
        model.bias -= float(RATE * g.sum() / np.sqrt(past["b"]))
        touched, moves = [], []
        for i, w in enumerate(model.filters):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            grad = np.zeros_like(w)
            for k, (code, near) in enumerate(nears[i]):
                grad[k] = np.einsum("nf,nfd->df", part, near)
                touched += [code.ravel() // ROWS, code.ravel() % ROWS]
                moves += 2 * [(part[:, :, None] * w[k].T[None]).reshape(-1, DIM)]
            self._step(("w", i), w, grad + DECAY * w)
            self._step(("s", i), model.shifts[i], part.sum(0))
        at, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        grad = np.zeros((len(at), DIM), np.float32)
        np.add.at(grad, inverse, np.concatenate(moves))
        grad[at == 0] = 0
        past["e"][at] += grad * grad
        model.embedding[at] -= RATE * grad / np.sqrt(past["e"][at])


def _peaks(model: Classifier, x: np.ndarray | None, flat: np.ndarray, w: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and value of every filter's maximum in each text; without ``x`` in stretches of ``CHUNK``."""
    if x is not None:
        z = activations(x, w)
        at = np.stack([s + z[s : s + n + 1].argmax(0) for s, n in zip(starts, sizes, strict=True)])
        return at, z[at, np.arange(FILTERS)]
    at = np.zeros((len(starts), FILTERS), np.int64)
    top = np.full((len(starts), FILTERS), -np.inf, np.float32)
    for i, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        for a in range(s, s + n + 1, CHUNK):
            stop = min(a + CHUNK, s + n + 1)
            z = activations(model.vectors(flat[a : stop + PAD - 1]), w)[: stop - a]
            best = z.argmax(0)
            value = z[best, np.arange(FILTERS)]
            higher = value > top[i]
            at[i, higher], top[i, higher] = a + best[higher], value[higher]
    return at, top


def _epochs(rows: int) -> int:
    return max(EPOCHS, min(60, -(-LEAST_STEPS * BATCH // rows)))


def fit(texts: list[str | None], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Classifier:
    """Train on given texts; ``weights`` scale each example's loss."""
    seen, docs = _text_counts(texts, _Rows(_hashes))
    often = docs >= LEAST_DOCS
    learner = Learner.start(_prints(seen[often], docs[often]), seed)
    codes = _Rows(learner.model.code)
    rows = [_encoded(t, codes) for t in texts]
    learner.learn(rows, labels, weights, _epochs(len(rows)))
    return learner.model


def _encoded(text: str | None, codes: _Rows) -> np.ndarray:
    words = _words(text)
    return np.fromiter(map(codes.__getitem__, words), np.int64, len(words))


def _text_counts(texts: list[str | None], hashes: _Rows) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and heads, ascending, and how many of the texts hold each."""
    own = [np.unique(np.array(list(map(hashes.__getitem__, set(_words(t)))), np.uint64)) for t in texts]
    return np.unique(np.concatenate(own), return_counts=True)


def _vocabulary(rows: DataFrame) -> np.ndarray:
    """Fingerprints by bucket: counted per batch, added up by Spark, one row a bucket to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("toxicity")
        hashes = _Rows(_hashes)
        for batch in batches:
            texts = batch["text"].tolist()
            for a in range(0, len(texts), 1024):
                seen, docs = _text_counts(texts[a : a + 1024], hashes)
                yield pd.DataFrame({"h": seen.view(np.int64), "n": docs})

    counts = rows.select("text").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") >= LEAST_DOCS)
    rank = F.struct("n", F.col("h").bitwiseXOR(F.lit(-(1 << 63))).alias("order"), "h")  # hashes without a sign
    owners = often.groupBy(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.max(rank)["h"].alias("h"))
    seen = owners.select("h").toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64)
    return _prints(seen, np.ones(len(seen), np.int64))


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Classifier:
    """Fit on all labelled rows that ``learn`` admits and calibrate per language."""
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    marked = marked if learn is None else marked.where(learn)
    marked = marked.groupBy(F.col(key).alias("_key")).agg((F.max(F.col(label)) > 0).cast("int").alias("y"))
    parts = min(PARTS, max(1, -(-marked.count() // HELD_ROWS)))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = _marked_only(docs.select(F.col(key).alias("_key"), lang.alias("lang"), F.col(text).alias("text")), marked)
    if parts == 1:
        dealt = rows.join(marked, "_key").repartition(1)
    else:  # the join deals the rows, so a text moves once
        dealt = rows.repartition(parts, "_key").join(marked.repartition(parts, "_key"), "_key")
    dealt = dealt.sortWithinPartitions("_key", F.xxhash64("text"))
    dealt = dealt.select("y", "lang", "text", _apart("_key").alias("apart"), F.spark_partition_id().alias("part"))
    dealt = dealt.persist(StorageLevel.DISK_ONLY)  # every round has the same rows in the same parts
    try:
        return _trained(dealt, parts)
    finally:
        dealt.unpersist()


def _marked_only(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """Without most rows that have no label, before any text moves: a bitmap of the labels' hashes.

    It has ``BITS`` bits however many labels there are, 64 to a row. What slips through is left to the join.
    """
    place = F.pmod(F.xxhash64(F.col("_key").cast("string")), F.lit(BITS))
    word, bit = F.floor(place / 64).alias("_word"), F.expr("shiftleft(1L, cast(_place % 64 as int))")
    bits = marked.select(place.alias("_place"), word).groupBy("_word").agg(F.bit_or(bit).alias("_bits"))
    found = rows.withColumn("_place", place).withColumn("_word", F.floor(F.col("_place") / 64)).join(F.broadcast(bits), "_word")
    return found.where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_place", "_bits")


@F.pandas_udf(T.BooleanType())
def _apart(keys: pd.Series) -> pd.Series:
    """The fifth of the rows that thresholds are calibrated on."""
    return pd.Series([xxhash.xxh32_intdigest(f"calibrate {k}") % 5 == 0 for k in keys], dtype=bool)


def _untrained() -> Classifier:
    nothing = np.zeros(0, np.float32)
    return Classifier(nothing, nothing, [], [], nothing, 0.0, {}, trained=False)


def _trained(dealt: DataFrame, parts: int) -> Classifier:
    """Fit on four fifths of the rows, calibrate on the rest."""
    counts = {(r["y"], r["apart"]): r["n"] for r in dealt.groupBy("y", "apart").agg(F.count("*").alias("n")).collect()}
    if len({y for y, _ in counts}) < 2:
        return _untrained()
    apart = {y for y, out in counts if not out} == {0, 1}
    rows = dealt.where(~F.col("apart")) if apart else dealt
    held = sum(n for (_, out), n in counts.items() if not (out and apart))
    learner = _started(_vocabulary(rows), rows, _epochs(min(held, HELD_ROWS)), alone=parts == 1)
    for turn in range(ROUNDS if parts > 1 else 0):
        _round(learner, rows, turn)
    if apart:
        learner.model.thresholds = _thresholds(dealt.where(F.col("apart") & F.col("lang").isNotNull()), learner.model)
    return learner.model


def _held(batches: Iterator[pd.DataFrame], codes: _Rows) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Encoded rows and labels, as many as a task holds at a time."""
    rows, labels, size = [], [], 0
    for batch in batches:
        for text, y in zip(batch["text"], batch["y"].tolist(), strict=True):
            rows.append(_encoded(text, codes))
            labels.append(y)
            size += len(rows[-1])
            if len(rows) == HELD_ROWS or size > HELD_WORDS:
                yield rows, np.array(labels, np.float64)
                rows, labels, size = [], [], 0
    if rows:
        yield rows, np.array(labels, np.float64)


def _started(prints: np.ndarray, rows: DataFrame, epochs: int, alone: bool) -> Learner:
    """The first part's first rows, learnt in several epochs; all its rows if there is no other part.

    The task begins with the driver's model, for both draw it from one seed, and only what it changed comes back.
    """
    used = np.flatnonzero(prints)
    shared = rows.sparkSession.sparkContext.broadcast((used.astype(np.int32), prints[used]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("toxicity")
        at, values = shared.value
        found, done = np.zeros(BUCKETS, np.int32), False
        found[at] = values
        own = Learner.start(found)
        first, past = own.model.embedding.copy(), own.past["e"].copy()
        for some, labels in _held(batches, _Rows(own.model.code)):
            if alone or not done:
                own.learn(some, labels, np.ones(len(some)), epochs)
            done = True
        if done:
            for number, body in _pieces(own, (own.model.embedding != first).any(1) | (own.past["e"] != past).any(1)):
                yield pd.DataFrame({"slice": [number], "body": [body]})

    learner = Learner.start(prints)
    _take(learner, rows.where(F.col("part") == 0).select("text", "y").mapInPandas(run, "slice int, body binary"))
    shared.destroy()
    return learner


def _pieces(own: Learner, changed: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The rows of the embedding that changed, by slice, and as number -1 all the rest of the model."""
    met = np.flatnonzero(changed)
    cuts = np.searchsorted(met, np.arange(0, ROWS + SLICE, SLICE))
    for number, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            at = met[a:b]
            yield number, pickle.dumps((at, own.model.embedding[at], own.past["e"][at]))
    yield -1, pickle.dumps(_dense(own))


def _take(learner: Learner, pieces: DataFrame) -> None:
    """Put pieces into ``learner``. They come as Arrow: rows would be copied several times in the driver's JVM."""
    found = pieces.toArrow()
    for number, body in zip(found["slice"].to_pylist(), found["body"], strict=True):
        values = pickle.loads(body.as_buffer())
        if number < 0:
            _set_dense(learner, values)
        else:
            at, value, past = values
            learner.model.embedding[at], learner.past["e"][at] = value, past


def _round(learner: Learner, rows: DataFrame, turn: int) -> None:
    """Every part goes on from ``learner`` over all its rows once; what they changed is averaged into it.

    A row of the embedding is averaged over the parts that met it, in slices by Spark, so
    neither a task nor the driver holds more than one model's worth.
    """
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(learner))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("toxicity")
        own, n, part = pickle.loads(shared.value), 0, None
        past = own.past["e"].copy()

        def numbered() -> Iterator[pd.DataFrame]:
            nonlocal part
            for batch in batches:
                if part is None and len(batch):
                    part = int(batch["part"].iloc[0])
                    own.rng = np.random.default_rng([turn, part])
                yield batch

        for some, labels in _held(numbered(), _Rows(own.model.code)):
            own.learn(some, labels, np.ones(len(some)), 1)
            n += len(some)
        if n:
            for number, body in _pieces(own, (own.past["e"] != past).any(1)):
                yield pd.DataFrame({"slice": [number], "part": [part], "n": [n], "body": [body]})

    moved = rows.select("text", "y", "part").mapInPandas(run, "slice int, part int, n long, body binary")
    _take(learner, moved.groupBy("slice").applyInPandas(_averaged, "slice int, body binary"))
    shared.destroy()


def _dense(learner: Learner) -> list:
    model, past = learner.model, learner.past
    kept = [past[k] for k in past if k != "e"]
    return [model.bias, model.weights, *model.filters, *model.shifts, *kept]


def _set_dense(learner: Learner, values: list) -> None:
    model, past, widths = learner.model, learner.past, len(WIDTHS)
    model.bias, model.weights = float(values[0]), values[1].astype(np.float32)
    model.filters = [v.astype(np.float32) for v in values[2 : 2 + widths]]
    model.shifts = [v.astype(np.float32) for v in values[2 + widths : 2 + 2 * widths]]
    past |= dict(zip([k for k in past if k != "e"], values[2 + 2 * widths :], strict=True))


def _averaged(pieces: pd.DataFrame) -> pd.DataFrame:
    """The parts' means, weighted by their rows, of one slice of the embedding or of all the rest."""
    pieces = pieces.sort_values("part")
    number, sizes = int(pieces["slice"].iloc[0]), pieces["n"].to_numpy(np.float64)
    bodies = [pickle.loads(b) for b in pieces["body"]]
    if number < 0:
        body = [sum(n * v for n, v in zip(sizes, values, strict=True)) / sizes.sum() for values in zip(*bodies, strict=True)]
    else:
        first = number * SLICE
        total, value, past = np.zeros(SLICE), np.zeros((SLICE, DIM)), np.zeros((SLICE, DIM))
        for n, (at, e, g) in zip(sizes, bodies, strict=True):
            total[at - first] += n
            value[at - first] += n * e
            past[at - first] += n * g
        own = np.flatnonzero(total)
        body = (own + first, *((x[own] / total[own, None]).astype(np.float32) for x in (value, past)))
    return pd.DataFrame({"slice": [number], "body": [pickle.dumps(body)]})


def _thresholds(rows: DataFrame, model: Classifier) -> dict[str, float]:
    """Per language, from counts by bin of the score: a group is ``BINS`` rows, whatever the input."""
    scored, name = with_scores(rows.select("lang", "text", "y"), model)
    s = F.col(name)
    bins = scored.groupBy("lang", F.floor(s * BINS).alias("bin")).agg(
        F.sum("y").alias("hits"), F.count("*").alias("n"), F.min(s).alias("low"), F.max(s).alias("high")
    )

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin", ascending=False)
        limit = _best_limit(*(group[c].to_numpy() for c in ("hits", "n", "low", "high")))
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "limit": [limit]})

    found = bins.groupBy("lang").applyInPandas(one, "lang string, limit double").where(F.col("limit") != 0.5)
    return {r["lang"]: r["limit"] for r in found.collect()}

def _best_limit(hits: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, least: int = 15) -> float:
    """The threshold with the best F1, the middle of the widest choice; 0.5 with few examples.

    Bins come by falling score: their toxic rows, rows, least and greatest score.
    """
    if min(hits.sum(), (n - hits).sum()) < least:
        return 0.5
    f1 = 2 * np.cumsum(hits) / (np.cumsum(n) + hits.sum())
    at = int(f1.argmax())
    below = high[at + 1] if at + 1 < len(high) else 0.0
    return float(np.clip((low[at] + below) / 2, 0.05, 0.95))


def scorer(spark, model: Classifier):
    """A column function: text to score. The model is a few megabytes by its parameters."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enter("toxicity")
        rows = _Rows(shared.value.code)
        for texts in batches:
            out = np.zeros(len(texts))
            values = texts.tolist()
            for a in range(0, len(values), 256):
                out[a : a + 256] = shared.value.scores([_encoded(t, rows) for t in values[a : a + 256]])
            yield pd.Series(out)
        rows = texts = values = out = None
        give_back()

    return score


def threshold(model: Classifier, lang: Column) -> Column:
    out = F.lit(0.5)
    for name, value in sorted(model.thresholds.items()):
        out = F.when(lang == name, value).otherwise(out)
    return out


def with_scores(docs: DataFrame, model: Classifier, text: str = "text") -> tuple[DataFrame, str]:
    """All rows with one more column, and that column's name."""
    name = fresh(docs, "toxicity")
    return docs.withColumn(name, scorer(docs.sparkSession, model)(F.col(text))), name


def keep_clean(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """Rows whose score stays below their language's threshold; their columns as they were."""
    scored, name = with_scores(docs, model, text)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return scored.where(F.col(name) < threshold(model, lang)).select(*[F.col(f"`{c}`") for c in docs.columns])
