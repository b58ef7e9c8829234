"""What a Python worker holds."""

import pytest

from veilframe.llm import common, packing, queries, tokens


def test_a_worker_gives_back_what_the_operator_before_freed(monkeypatch):
    asked = []
    monkeypatch.setattr(common, "_trim", asked.append, raising=False)
    monkeypatch.setattr(common, "_now", ["one"])
    monkeypatch.setattr(common, "REMEMBERED", {"one": lambda: asked.append("one"), "two": lambda: asked.append("two")})
    for _ in range(2):
        common.enter("two")
    assert asked == ["one", 0]


def test_packing_takes_texts_out_of_a_batch_by_ranges(odd):
    plan = packing.pack(odd, queries.vocabulary("byte_bpe_50k.json"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


@pytest.mark.parametrize("texts", [[], [None, "", "abcd"], ["ab", None, "cdefg", "h", "ijklmnop", "q"]])
def test_ranges_from_lengths(texts):
    assert list(tokens.text_batches(texts, 4)) == list(tokens.size_batches([len(t or "") for t in texts], 4))


def test_a_smaller_memory_gives_the_same_ids():
    path = queries.vocabulary("byte_bpe_50k.json")
    texts = [f"word{i % 50} other{i}, and one." for i in range(300)]
    large, small = tokens.encoder(path, True, 1), tokens.encoder(path, True, 1, 40)
    for a in range(0, 300, 20):
        assert [x.tolist() for x in large.encode(texts[a : a + 20])] == [x.tolist() for x in small.encode(texts[a : a + 20])]
    assert small.known < 300 < large.known
