"""Language identification by prediction by partial matching over bytes.

Per language a tree of byte contexts up to ``ORDER`` bytes long counts what follows
each. A byte's code length comes from the longest context that the tree has: the share
of the byte there, or, where it never followed, the escape's share and then the next
shorter context, down to one in 256. Escapes count as often as a context has different
successors (method C, without exclusions). Statistics are frozen: a text does not
change them, so its code length in each language is an exact sum over its bytes, and the
language with the least one is its language.

The message is the text in lower case, UTF-8, with every stretch of ASCII blanks as one
blank behind each word. Contexts begin at the blank before a word, so the code length of
a word is its own, and a batch of texts pays once for every different word. All trees
stand in one table: the longest string of context and byte that any language has gives
its code length in every language, escapes worked in.

Trees are grown from at most ``SAMPLE`` documents of each language, picked by hash of
their id and text, of texts up to ``SAMPLE_CHARS`` characters: a bound on what one task
per language holds and on the model. Every text is scored whole.

A null text and one without a letter is ``und`` with score 0, as is every text if
nothing could be learned; ties go to the smallest language; documents without an id are
not learned from; a repeated id counts with each of its texts. The score is the
language's share among all when every code length is a probability: 1 for one language.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounded import broadcast_if_small
from .common import fresh, spans_of

ORDER = 4
SAMPLE, SAMPLE_CHARS = 2_000, 50_000
SPARE = 4
START = 0x20
TEXTS = 512  # scored at a time
UNKNOWN = "und"


@dataclass
class Words:
    """Different words, one after another with a blank behind each, and who has them."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    index: np.ndarray  # the word of every occurrence
    owner: np.ndarray  # its text


def words_of(texts: Sequence[str | None]) -> Words:
    column = pa.array([(t or "").lower() for t in texts], pa.large_string())
    pieces = pc.ascii_split_whitespace(column)
    owner = pc.list_parent_indices(pieces).to_numpy()
    flat = pieces.flatten().dictionary_encode()
    index = flat.indices.to_numpy()
    words = flat.dictionary.cast(pa.large_binary())
    sizes = pc.binary_length(words).to_numpy().astype(np.int64)
    real = sizes[index] > 0  # blanks at the ends of a text leave empty pieces
    buffers = words.buffers()
    raw = np.frombuffer(buffers[2], np.uint8) if len(words) and buffers[2] is not None else np.zeros(0, np.uint8)
    offsets = np.frombuffer(buffers[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    data = np.full(int((sizes + 1).sum()), START, np.uint8)
    data[spans_of(starts, sizes)] = raw[spans_of(offsets[:-1], sizes)]
    return Words(data, starts, sizes + 1, index[real], owner[real])


def grams(words: Words, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per context length k the number of each k bytes of context and the byte behind; and how long contexts are.

    ``grams[k][i]`` holds for byte i the k bytes before it and itself, where it has k.
    """
    place = np.arange(len(words.data)) - np.repeat(words.starts, words.sizes)
    known = np.minimum(place + 1, order)  # the blank before the word is context too
    now = words.data.astype(np.uint64)
    out = [now]
    for k in range(1, order + 1):
        back = np.full(len(now), START, np.uint64)  # before the first byte of a word stands the blank
        back[k:] = words.data[:-k] if k < len(now) else back[k:]
        back[place == k - 1] = START
        out.append(out[-1] | (back << np.uint64(8 * k)))
    return out, known


@dataclass
class Trees:
    """Of each context length: sorted strings (context and byte) with code lengths per language,
    and sorted contexts with what an escape from them costs (0 where a language lacks them)."""

    langs: list[str]
    strings: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def word_costs(self, words: Words) -> np.ndarray:
        """Code lengths in bits, per word and language."""
        if not len(words.data):
            return np.zeros((len(words.sizes), len(self.langs)))
        order = len(self.strings) - 1
        keys, known = grams(words, order)
        bits = np.zeros((len(words.data), len(self.langs)))
        open_ = np.arange(len(words.data))
        for k in range(order, -1, -1):
            here = open_[known[open_] >= k]
            found, at = _find(self.strings[k], keys[k][here])
            bits[here[found]] += self.costs[k][at[found]]
            rest = here[~found]
            seen, at = _find(self.contexts[k], keys[k][rest] >> np.uint64(8))
            bits[rest[seen]] += self.escapes[k][at[seen]]
            open_ = np.concatenate([open_[known[open_] < k], rest])
        bits[open_] += 8.0
        return np.add.reduceat(bits, words.starts, axis=0)

    def lengths(self, texts: Sequence[str | None]) -> np.ndarray:
        """Code lengths in bits, per text and language."""
        words = words_of(texts)
        per = self.word_costs(words)[words.index]
        out = np.zeros((len(texts), len(self.langs)))
        for i in range(len(self.langs)):
            out[:, i] = np.bincount(words.owner, per[:, i], len(texts))
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return (table[at] == keys) if len(table) else np.zeros(len(keys), bool), at


def count(texts: Sequence[str | None], order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per context length the strings of context and byte, and how often they occur."""
    words = words_of(texts)
    keys, known = grams(words, order)
    often = np.repeat(np.bincount(words.index, minlength=len(words.sizes)), words.sizes)
    out = []
    for k in range(order + 1):
        here = (known >= k) & (often > 0)
        strings, inverse = np.unique(keys[k][here], return_inverse=True)
        out.append((strings, np.bincount(inverse, often[here], len(strings)).astype(np.int64)))
    return out


def joined(counts: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Trees:
    """The trees of all languages as one table, shorter contexts first."""
    langs = sorted(counts)
    strings, costs, contexts, escapes = [], [], [], []
    order = len(counts[langs[0]]) - 1
    for k in range(order + 1):
        all_strings = np.unique(np.concatenate([counts[x][k][0] for x in langs]))
        all_contexts = np.unique(all_strings >> np.uint64(8))
        cost = np.zeros((len(all_strings), len(langs)))
        escape = np.zeros((len(all_contexts), len(langs)))
        # What a string costs where a language has it not: the escape, and the shorter context.
        shorter = np.full((len(all_strings), len(langs)), 8.0)
        if k:
            tail = all_strings & np.uint64((1 << 8 * k) - 1)
            shorter = costs[k - 1][np.searchsorted(strings[k - 1], tail)]
        home = np.searchsorted(all_contexts, all_strings >> np.uint64(8))
        for i, x in enumerate(langs):
            own, n = counts[x][k]
            place = np.searchsorted(all_strings, own)
            total = np.bincount(home[place], n, len(all_contexts))
            kinds = np.bincount(home[place], minlength=len(all_contexts))
            has = total > 0
            escape[has, i] = np.log2((total[has] + kinds[has]) / kinds[has])
            cost[:, i] = escape[home, i] + shorter[:, i]
            cost[place, i] = np.log2((total + kinds)[home[place]] / n)
        strings.append(all_strings)
        costs.append(cost)
        contexts.append(all_contexts)
        escapes.append(escape)
    return Trees(langs, strings, costs, contexts, escapes)


def learn(docs: DataFrame, rows: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER) -> Trees | None:
    """The trees of the rows that ``rows`` admits and that have a language; none if no row has."""
    fits = rows & F.col(lang).isNotNull() & F.col(key).isNotNull() & (F.length(text) <= SAMPLE_CHARS)
    known = docs.where(fits).select(F.col(lang).alias("lang"), F.col(key).alias("key"), F.col(text).alias("text"))
    counts = docs.where(rows & F.col(lang).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_n"))
    # Only rows with a small hash, some SPARE times the sample, are moved to be ranked.
    turn = F.xxhash64("key", "text")
    share = F.pmod(turn, F.lit(1 << 32)) / F.lit(float(1 << 32))
    some = known.join(broadcast_if_small(counts), F.col("lang") == F.col("_lang")).where(share * F.col("_n") < SPARE * SAMPLE)
    first = Window.partitionBy("lang").orderBy(share, turn, "key")
    sample = some.withColumn("_turn", F.row_number().over(first)).where(F.col("_turn") <= SAMPLE).select("lang", "text")

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "tree": [pickle.dumps(count(group["text"].tolist(), order))]})

    trees = sample.groupBy("lang").applyInPandas(grow, "lang string, tree binary").collect()
    return joined({r["lang"]: pickle.loads(r["tree"]) for r in trees}) if trees else None


def _scorer(spark, trees: Trees):
    shared = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("lang string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values, found, shares = texts.tolist(), [], []
            for a in range(0, len(values), TEXTS):
                bits = shared.value.lengths(values[a : a + TEXTS])
                best = bits.argmin(1)
                found += [shared.value.langs[i] for i in best]
                shares.append(1 / np.exp2(np.minimum(bits.min(1)[:, None] - bits, 0.0)).sum(1))
            yield pd.DataFrame({"lang": found, "score": np.concatenate(shares) if shares else np.zeros(0)})

    return score


def with_language(docs: DataFrame, trees: Trees | None, text: str = "text") -> tuple[DataFrame, str]:
    """All rows with one more column, a struct of ``lang`` and ``score``, and that column's name."""
    name = fresh(docs, "language")
    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if trees is None:
        return docs.withColumn(name, unknown), name
    lettered = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    found = _scorer(docs.sparkSession, trees)(F.when(lettered, F.col(text)))
    return docs.withColumn(name, F.when(lettered, found).otherwise(unknown)), name
