"""Exact tokenization of whole texts at the cost of one lookup per word.

Both vocabularies cut a text at blanks before anything else, so the ids of a text
are those of its blank-separated pieces in a row. A worker encodes each piece it
has not met with the tokenizers library and remembers it, up to a bounded number
of pieces; texts are never cut or shortened. Pieces made of plain Latin words and
marks are put together from their words, which go straight to the library's model.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import REMEMBERED, enter, spans_of

MEMORY, PARTS_MEMORY = 500_000, 100_000  # pieces a worker remembers, and parts of composed ones
WHOLE_MEMORY = 10_000_000  # characters of texts that it remembers whole
# Before such a character a blank always opens a new piece of the byte vocabulary.
BYTE_SPLIT = re.compile(" (?=[!-~¡-ᙿ])")
ODD_BLANK = "\x01| [^!-~\u00a1-\u167f]| $"  # texts with these are cut by the pattern above
CUT = "\x01"

# Runs of Latin letters and of marks are pre-tokens of both vocabularies, and so is a
# single line end between them; apostrophes, digits and anything else are not simple.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = re.compile(f" ?[{LATIN}]+")
PART = re.compile(f" ?(?:[{LATIN}]+|[.,!?;:]+)|\n")
SIMPLE = re.compile(f" ?[{LATIN}.,!?;:](?:[{LATIN}.,!?;:]|\n(?!\n))*")
# One mark between a letter and a blank or line end stands alone in both vocabularies.
MARKED, SPREAD = f"([{LATIN}])([.,]){CUT}", f"\\1{CUT}\\2{CUT}"
MARKED_LINE, SPREAD_LINE = f"([{LATIN}])([.,])\n([{LATIN}])", f"\\1{CUT}\\2{CUT}\n{CUT}\\3"
# Byte-level vocabularies write a byte as a visible character; those without one are moved up.
_visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _visible)}

_encoders: dict[tuple, Encoder] = {}
REMEMBERED["tokens"] = _encoders.clear


def encoder(path: str, blanks: bool, end: int, memory: int = MEMORY) -> Encoder:
    """One encoder per worker; ``blanks``: the vocabulary keeps the blank before a word.

    ``memory`` is how many pieces it remembers; fewer take less of the worker and more time.
    """
    enter("tokens")
    key = (path, blanks, end, memory)
    if key not in _encoders:
        _encoders[key] = Encoder(path, blanks, end, plain=False)
        _encoders[key].memory = memory
    return _encoders[key]


class _Pieces(dict):
    """Piece to number; an unknown piece gets the next number and waits for its ids."""

    def __init__(self, start: int) -> None:
        super().__init__()
        self.new: list[str] = []
        self.next = start

    def __missing__(self, piece: str) -> int:
        number = self[piece] = self.next
        self.next += 1
        self.new.append(piece)
        return number


class _Words(dict):
    """Word to its ids as bytes, made when first asked for."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        got = self[word] = self.make(word)
        return got


def _room(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``more`` behind the first ``used`` entries; the array doubles when it is full."""
    if used + len(more) > len(held):
        held = np.concatenate([held[:used], np.empty(used + 2 * len(more), held.dtype)])
    held[used : used + len(more)] = more
    return held


class Encoder:
    """``plain``: strings of added tokens in a text are ordinary text. Else, as the file says, they
    become those tokens; texts that hold one are encoded whole by the library."""

    def __init__(self, path: str, blanks: bool, end: int, plain: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.encode_special_tokens = plain
        added = [] if plain else [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        # What all of them begin with, as far as it has no case, is quicker to look for.
        self.hint = re.match(r"[!-@]*(?:[\[-`{-~][!-@]*)*", os.path.commonprefix(added))[0] if added else ""
        self.blanks, self.end, self.memory = blanks, end, MEMORY
        self._forget()

    def _forget(self) -> None:
        self.pieces = _Pieces(1)  # piece 0 is the end of a text
        self.words = _Words(self._word)
        self.ids = np.array([self.end], np.uint32)
        self.starts, self.sizes = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.known, self.used = 1, 1
        self.whole = 0  # characters of whole texts among the pieces

    def _holds_added(self, text: str | None) -> bool:
        return bool(text and self.hint in text and self.added.search(text))

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token: a run of Latin letters, of marks, or a line end."""
        plain = word if self.blanks else word.lower()
        if not plain.isalpha() or not plain.isascii():
            plain = plain.encode().decode("latin-1").translate(BYTES)
        return array("I", [t.id for t in self.tool.model.tokenize(plain)]).tobytes()

    def _cut(self, texts: Sequence[str | None]) -> pa.ListArray:
        """Pieces of each text, the blank before a piece at its front; Arrow does the cutting."""
        if not self.blanks:
            plain = [_lower(t or "").replace("\n", CUT).replace(" ", CUT) for t in texts]
            held = pc.replace_substring_regex(pa.array(plain, pa.string()), MARKED, SPREAD)
            held = pc.split_pattern(held, CUT)
            odd = {i: t.replace("\n", " ").split(" ") for i, t in enumerate(texts) if t and CUT in t}
            if not odd:
                return held
            return pa.array([odd.get(i, p) for i, p in enumerate(held.to_pylist())], pa.list_(pa.string()))
        column = pa.array([t or "" for t in texts], pa.string())
        odd = pc.match_substring_regex(column, ODD_BLANK).to_pylist()
        held = pc.replace_substring(column, " ", f"{CUT} ")
        held = pc.replace_substring_regex(held, MARKED, SPREAD)
        held = pc.split_pattern(pc.replace_substring_regex(held, MARKED_LINE, SPREAD_LINE), CUT)
        if not any(odd):
            return held
        parts = held.to_pylist()
        for i in (i for i, o in enumerate(odd) if o):
            first, *rest = BYTE_SPLIT.split(texts[i])
            parts[i] = [first, *(f" {p}" for p in rest)]
        return pa.array(parts, pa.list_(pa.string()))

    def _learn(self) -> None:
        """Ids of the pieces that wait."""
        if not self.pieces.new:
            return
        asked = self.pieces.new
        self.pieces.new = []
        if len(self.words) > min(PARTS_MEMORY, self.memory // 5):
            self.words.clear()
        got: list[bytes] = []
        odd: list[int] = []
        part = self.words.__getitem__
        for i, piece in enumerate(asked):
            if PLAIN.fullmatch(piece):
                got.append(self._word(piece))
            elif SIMPLE.fullmatch(piece):
                got.append(b"".join(map(part, PART.findall(piece))))
            else:
                odd.append(i)
                got.append(b"")
        found = self.tool.encode_batch_fast([asked[i] for i in odd], add_special_tokens=False)
        for i, e in zip(odd, found, strict=True):
            got[i] = array("I", e.ids).tobytes()
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        starts = self.used + np.cumsum(sizes) - sizes
        self.ids = _room(self.ids, self.used, np.frombuffer(b"".join(got), np.uint32))
        self.starts = _room(self.starts, self.known, starts)
        self.sizes = _room(self.sizes, self.known, sizes)
        self.known += len(got)
        self.used += int(sizes.sum())

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text's followed by the end id; and the texts' counts."""
        if self.pieces.next > self.memory or self.whole > WHOLE_MEMORY:
            self._forget()
        whole = [] if self.added is None else [i for i, t in enumerate(texts) if self._holds_added(t)]
        if whole:
            rest = list(texts)
            for i in whole:
                rest[i] = None
                self.whole += len(texts[i])
            held = self._cut(rest).to_pylist()
            for i in whole:
                held[i] = [texts[i]]
            pieces = pa.array(held, pa.list_(pa.string()))
        else:
            pieces = self._cut(texts)
        shares = pieces.flatten().dictionary_encode()
        known = self.pieces
        asked = shares.dictionary.to_numpy(zero_copy_only=False)
        names = np.fromiter(map(known.__getitem__, asked), np.int64, len(asked))
        self._learn()
        counts = np.diff(pieces.offsets.to_numpy())
        ends = np.cumsum(counts + 1)
        at = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        inner = np.ones(len(at), bool)
        inner[ends - 1] = False  # the end of each text stays piece 0
        at[inner] = names[shares.indices.to_numpy()]
        sizes = self.sizes[at]
        flat = self.ids[spans_of(self.starts[at], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return flat, upto[ends] - upto[ends - counts - 1]


def _lower(text: str) -> str:
    """Lower case where a Latin text's is that of its characters; else the library does it."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


@cache
def sentence_ends(path: str) -> np.ndarray:
    """Per id of a byte-level vocabulary: does its string end a sentence or a line?"""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = np.zeros(max(vocab.values()) + 2, bool)
    for piece, i in vocab.items():
        out[i] = piece[-1:] in ".!?Ċ"  # the last is the byte-level form of a line end
    return out


def text_batches(texts: Sequence[str | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters each, to bound memory."""
    return size_batches([len(text or "") for text in texts], most)


def size_batches(sizes: Sequence[int], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """The same from the texts' lengths."""
    start = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)
