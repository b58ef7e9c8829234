"""Strings of added tokens become those tokens in the queries, as the tokenizer file says."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilframe.llm import tokens

TEXTS = ["hello <|endoftext|> there", "<|startoftext|>a b<|endoftext|>", "A<|EndOfText|> b", None, "", "plain <| text", "Plain text, again.", "<|endoftext|>"]


@pytest.mark.parametrize(("name", "blanks", "end"), [("byte_bpe_50k.json", True, 1), ("word_bpe_49k.json", False, 2)])
def test_added_tokens(name, blanks, end, monkeypatch):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, end] for t in TEXTS]
    monkeypatch.setattr(tokens, "WHOLE_MEMORY", 40)
    tool = tokens.encoder(path, blanks, end)
    for _ in range(3):
        ids, counts = tool.encode(TEXTS)
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert any(i in ids for i in plain.get_added_tokens_decoder())
