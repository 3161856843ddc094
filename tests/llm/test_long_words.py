"""Unbroken words: the walk of one piece alone gives what steps side by side and the library give."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from glimmer.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH, public_tokenizers.PATTERN)


@pytest.mark.parametrize("letters", ["ab", "thesing", "abcdefghijklmnopqrstuvwxyzéñß", "x"])
def test_long_pieces_equal_the_library(encoder, letters, monkeypatch):
    rng = np.random.default_rng(len(letters))
    words = ["".join(rng.choice(list(letters), n)) for n in (1, 2, 30, 7000, 50_000)]
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    want = [library._core_bpe.encode_single_piece(w.encode()) for w in words]
    for alone in (0, 2, 8):
        monkeypatch.setattr(bpe, "_ALONE", alone)
        assert [np.frombuffer(i, "<u4").tolist() for i in encoder.pieces([w.encode() for w in words])] == want
