"""What a Python worker holds: nothing freed after its task, and little per token."""

from __future__ import annotations

import tracemalloc

import numpy as np

from veilframe.llm import common, packing, tokens


def test_freed_memory_goes_back_after_the_last_batch(monkeypatch):
    """Once per task, when the step's own values are gone."""
    said = []

    def run(batches):
        for batch in batches:
            yield batch
        said.append("over")

    step = common.tidy(run)
    monkeypatch.setattr(common, "give_back", lambda: said.append("back"))
    found = step(iter([1, 2]))
    assert next(found) == 1 and next(found) == 2 and not said
    assert list(found) == [] and said == ["over", "back"]


def test_cut_places_take_few_bytes_a_token():
    """Under 4 bytes a token at any time: the costs of all places take one each."""
    n = 1 << 20
    ids, ends = np.ones(n, np.uint32), np.zeros(3, bool)
    tracemalloc.start()
    places, costs = packing.cut_places(ids, np.array([n // 2, n // 2]), ends)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 4 * n
    assert costs.dtype == np.int64
    assert dict(zip(places.tolist(), costs.tolist(), strict=True)) == {
        p: 0 if p % (n // 2) == 0 else packing.HARD_COST for p in range(0, n + 1, packing.HARD_STEP)
    }


def test_sentence_ends_are_read_once_a_worker(tmp_path):
    path = tmp_path / "v.json"
    path.write_text('{"model": {"vocab": {"a": 0, "b.": 1}}}')
    first = tokens.sentence_ends(str(path))
    assert first.tolist() == [False, True, False]
    assert tokens.sentence_ends(str(path)) is first
