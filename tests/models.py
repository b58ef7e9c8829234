"""Plain sequential models the Spark operators are compared with."""

import re

import regex

from veilframe.functions.text import TOKEN


def tokens(text):
    return [(m.start(), m.end()) for m in regex.finditer(TOKEN, text)]


def winners(spans):
    """Best span of every connected group of overlapping intervals.

    ``spans`` are tuples ``start, end, chunk_id, pos, label, score``.
    """
    groups = []
    for span in sorted(spans):
        if groups and span[0] < max(s[1] for s in groups[-1]):
            groups[-1].append(span)
        else:
            groups.append([span])
    return [min(g, key=lambda s: (-s[5], s[:4])) for g in groups]


def split_point(text, end, lookback=80):
    window_start = max(0, end - lookback)
    for sep in ("\n\n", "\n", ". ", "? ", "! "):
        at = text.rfind(sep, window_start, end)
        if at >= 0:
            return at + len(sep)
    return end


def chunks(text, max_length, stride):
    """Token windows whose right edge moves back to a natural split."""
    toks = tokens(text)
    n = len(toks)
    if n <= max_length:
        return [(0, len(text))]
    out, first = [], 0
    while True:
        stop = min(n, first + max_length - 2)
        if stop < n:
            limit = split_point(text, toks[stop - 1][1])
            fitting = [t for t in range(first, stop) if toks[t][0] <= limit]
            stop = fitting[-1] + 1 if fitting else stop
        out.append((toks[first][0], toks[stop - 1][1]))
        if stop == n:
            break
        first = max(stop - int(max_length * stride), first + 1)
    out[-1] = (out[-1][0], len(text))
    return out


GROUPS = [  # digits of the groups of a value, and what stands between them
    ("IP", [(1, 3)] * 4, "..."),
    ("SOCIALNUMBER", [(3, 3), (2, 2), (4, 4)], "--"),
    ("IDCARD", [(12, 10**9)], ""),
    ("IDCARD", [(4, 4)] * 4, "---"),
    ("DATE", [(4, 4), (2, 2), (2, 2)], "--"),
    ("DATE", [(1, 2), (1, 2), (2, 4)], "//"),
    ("TIME", [(1, 2), (2, 2), (2, 2)], "::"),
    ("TIME", [(1, 2), (2, 2)], ":"),
    ("POSTCODE", [(5, 5), (4, 4)], "-"),
    ("POSTCODE", [(5, 5)], ""),
]


def numbers(text):
    """Values of digit groups, run by run, with a state per group; TEL by its own pattern."""
    out = []
    for run in re.finditer(r"(?:\+?\d{1,3}[ -]?\(\d+\) ?|\+\d+[ -]?|\(\d+\) ?)?\d[\d./:-]*(?: ?[AaPp][Mm])?", text, re.ASCII):
        s, a = run[0], run.start()
        if len(s) < 4:
            continue
        groups = [m.span() for m in re.finditer(r"\d+", s, re.ASCII)]
        found, k = [], 0
        while k < len(groups):
            begin, plus = groups[k][0], groups[k][0] > 0 and s[groups[k][0] - 1] in "+("
            value = None
            for at in ([begin - 1] if plus else []) + [begin]:
                if value is None and (m := re.compile(r"(?:\+?\d{1,3}[ -]?)?(?:\(\d{3}\) ?|\b\d{3}-)\d{3}-\d{4}(?!\d)", re.ASCII).match(s, at)):
                    value = ("TEL", m.start(), m.end())
                if at == begin and (value is None or value[1] == begin):
                    for label, sizes, joints in GROUPS:
                        some = groups[k : k + len(sizes)]
                        fits = len(some) == len(sizes) and all(x <= e - b <= y for (b, e), (x, y) in zip(some, sizes))
                        if fits and all(s[some[i][1] : some[i + 1][0]] == j for i, j in enumerate(joints)):
                            if value is None or label == "IP":
                                end = some[-1][1]
                                if label == "TIME" and (m := re.compile(" ?[AaPp][Mm]").match(s, end)):
                                    end = m.end()
                                value = (label, begin, end)
                            break
            if value:
                found.append(value)
                k = next((i for i in range(k, len(groups)) if groups[i][0] >= value[2]), len(groups))
            else:
                k += 1
        for i, (label, b, e) in enumerate(found):
            upto = found[i + 1][1] if i + 1 < len(found) else len(s)
            ends = [y for x, y in groups if e <= x and y <= upto]
            if i == 0 and any(y <= b for _, y in groups):
                b = 0
            out.append((label, a + b, a + max([e, *ends])))
    return out
