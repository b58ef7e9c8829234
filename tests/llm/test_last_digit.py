"""Equal strings within a task are settled before the last digit is dealt out."""

import types

import numpy as np
import pandas as pd
import pytest
import zstandard

from veilframe.llm import substrings


@pytest.mark.parametrize("hold", [2_000_000, 300])
def test_one_document_s_strings_are_sent(monkeypatch, hold):
    monkeypatch.setattr(substrings, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 5)))
    monkeypatch.setattr(substrings, "STRINGS", hold, raising=False)
    raw = zstandard.ZstdCompressor().compress(bytes(range(40, 140)))
    ids = list(range(60, 0, -1))
    asked = [np.array([(40 << 32) | (30 << 8) | 1])] * 60  # 30 strings, from byte 10 on
    batches = [pd.DataFrame({"doc_id": ids[a : a + 20], "mark": 1, "raw": [raw] * 20, "anchors": asked[:20]}) for a in (0, 20, 40)]
    out = pd.concat(substrings._strings(iter(batches), 50, 8))
    strings = out[out["kind"] == substrings.ANCHORS]
    sent = sum(len(zstandard.ZstdDecompressor().decompress(b)) for b in strings["rows"]) // substrings.STRING.itemsize
    assert sent == 30 * (1 if hold > 1800 else 6)
    assert strings["part"].nunique() > 1  # dealt by the string, not by the one gram
    found = pd.concat(substrings._last_digit(g, 50) for _, g in out.groupby("part"))
    spans = found.groupby("doc_id")["span"].apply(lambda some: {b for s in some for b in range(s >> 32, s & 0xFFFFFFFF)})
    assert set(spans.index) == set(range(2, 61)) and all(s == set(range(10, 89)) for s in spans)
