"""Words of whole texts, cut in Arrow and handled once per distinct word of a batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix64


def word_codes(texts: Sequence[str | None], code: Callable[[str], int], kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """``code`` of every word of the texts, A-Z in lower case, and the texts' word counts."""
    column = pc.ascii_lower(pa.array([t or "" for t in texts], pa.string()))
    pieces = pc.ascii_split_whitespace(column)
    flat = pieces.flatten()
    shares = flat.dictionary_encode()
    words = shares.dictionary.to_numpy(zero_copy_only=False)
    # Blanks at the ends of a text leave empty pieces, which are no words.
    real = np.fromiter(map(bool, words), bool, len(words))
    codes = np.fromiter(map(code, words), kind, len(words))
    index = shares.indices.to_numpy()
    stays = real[index]
    upto = np.concatenate([[0], np.cumsum(stays)])
    return codes[index[stays]], np.diff(upto[pieces.offsets.to_numpy()])


def shingle_sets(words: np.ndarray, counts: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word windows.

    A text with fewer words has its whole sequence as its one window; one without
    words has none.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    n = len(words)
    windows = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        windows = mix64(windows * np.uint64(31) + words[k : k + len(windows)] + np.uint64(k + 1))
    out = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(windows[a : b - width + 1]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                one = mix64(one * np.uint64(37) + words[k : k + 1])
            out.append(one)
        else:
            out.append(words[:0])
    return out
