"""Links of lines of one to eight characters."""

import collections
import random

from test_texts import distance

from veilframe.llm import lines


def test_short_lines_are_linked(spark):
    rng = random.Random(3)
    names = ["Ciónque.", "Ciónqueñ.", "abcdefghijklmno", "abcdefghijklmnop", "aaaaaaaaaaaaaaaa"]
    names += ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 8))) for _ in range(120)]
    rows = [(i, "\n".join(names[i::5]) + "\nx") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    first = {}
    for i, t in rows:
        for n, s in enumerate(t.split("\n")):
            first.setdefault(s, (i, n))
    near = {a: [b for b in first if a != b and distance(a, b) <= 2] for a in first}
    want = collections.Counter(
        (i, n, len(near[s]), (i, n) != first[s] or any(first[b] < first[s] for b in near[s])) for i, t in rows for n, s in enumerate(t.split("\n"))
    )
    got = collections.Counter((r["doc_id"], r["line_no"], r["n_links"], r["removed"]) for r in lines.line_classes(docs).collect())
    assert got == want
