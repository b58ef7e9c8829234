"""Odd rows for every operator."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use inside.
        *[T.StructField(n, T.StringType()) for n in ("mix", "_plan", "_measured", "toxicity", "_gone", "_mark", "y", "node", "tie", "h")],
    ]
)


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def sample(seed: int = 5) -> list[tuple]:
    """Nulls in every column, empty, blank and long texts, copies, near copies, repeated rows and ids."""
    rng = random.Random(seed)
    base, line = words(rng, 200), words(rng, 12)
    rows = [(None, base, "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "b"), (4, "one two", "en", None)]
    rows += [(5, base, "en", "a"), (6, base, "de", "b"), (6, base, "de", "b"), (7, base + " more", None, "b"), (7, "other " + base, "en", "c")]
    rows += [(8, "\n".join([line, words(rng, 9), line, line]), "en", "c"), (9, line + "\n" + line.replace("a", "b", 1), "en", "c")]
    rows += [(10, words(rng, 6000), "en", "c"), (11, "#$%&*|<> " * 60, "en", "a"), (12, "x " * 400, "en", "a"), (13, "日本 語 \u0085 á " * 20, "ja", "d")]
    rows += [(i, words(rng, rng.randint(1, 300)) + "\n" + line, rng.choice(["en", "fr"]), rng.choice("abc")) for i in range(14, 60)]
    return [(i, t, lang, s, None if t is None else len(t), *(["kept"] * 10)) for i, t, lang, s in rows]
