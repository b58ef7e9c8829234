"""Planted junk, one statistic at a time, and copies that make up a third of a group."""

import random

from samples import words

from veilframe.llm import outliers

SCHEMA = "doc_id long, text string, lang string, source string"


def clean(rng, n=150):
    return "\n".join(" ".join(words(rng, 12).split() + [str(rng.random())]) for _ in range(n // 13))


def marked(rng, percent):
    """A clean text of which so many percent of the characters are symbols."""
    return "".join(rng.choice("#*$%&|<>") if c not in " \n" and rng.random() < percent / 100 else c for c in clean(rng))


def repeating(rng):
    """Words of which some 40 % stand in repeated windows."""
    some = clean(rng).split()
    return " ".join(some + some[: len(some) // 4])


def lined(rng, n):
    line = words(rng, 2)
    return clean(rng, 400) + f"\n{line}" * (n + 1)


JUNK = {
    "symbols 10 %": lambda rng: marked(rng, 12),
    "symbols 20 %": lambda rng: marked(rng, 20),
    "lines": lambda rng: lined(rng, 20),
    "repeats": repeating,
}


def test_junk_of_one_statistic_goes(spark):
    rng, rows = random.Random(12), []
    for kind, make in JUNK.items():
        some = [make(rng) if i < 20 else clean(rng, max(70, int(rng.lognormvariate(5.5, 0.4)))) for i in range(300)]
        rows += [(len(rows) + i, t, "en", kind) for i, t in enumerate(some)]
    found = outliers.reject_outliers(spark.createDataFrame(rows, SCHEMA).coalesce(4)).collect()
    assert not any(r["base_failed"] for r in found)
    gone = {r["doc_id"] for r in found if not r["kept"]}
    planted = {i for i in range(len(rows)) if i % 300 < 20}
    assert gone >= planted and len(gone - planted) <= 12


def test_a_third_of_copies_goes(spark):
    rng = random.Random(13)
    copy = marked(rng, 40)
    rows = [(i, copy if i < 100 else marked(rng, 20) if i < 105 else clean(rng, max(70, int(rng.lognormvariate(5.5, 0.4)))), "en", "s") for i in range(300)]
    found = outliers.reject_outliers(spark.createDataFrame(rows, SCHEMA).coalesce(4)).collect()
    gone = {r["doc_id"] for r in found if not r["kept"]}
    assert gone >= set(range(105)) and len(gone) <= 110
