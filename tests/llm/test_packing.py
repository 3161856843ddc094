"""Packing's tokens: the ids are the tokenizer's own, at less work and memory."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from glimmer.llm import packing


def tokens() -> packing.WordTokens:
    return packing.tokens_of(public_tokenizers.path(packing.VOCABULARY))


def same(texts: list[str]) -> None:
    own = tokens()
    for text, ids in zip(texts, own.texts(pa.array(texts)).to_pylist(), strict=True):
        assert list(np.frombuffer(ids, "<u4")) == own.tokenizer.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aestdmrvlLST''.!12 \n\xa0éÉßΣσςİŉ́’‧ "), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=8))
def test_ids_are_the_tokenizers(texts):
    same(texts)


def test_ids_of_all_characters_beside_others():
    same([f"a{c}b {c} {c}{c}1'{c} {c.upper()}" for c in map(chr, (*range(0x600), *range(0x2000, 0x2100), 0x3042, 0xAC00, 0x1161, 0xFB01, 0x1F600))])


def test_plain_words_reach_the_tokenizer_as_distinct_pieces(monkeypatch):
    own, sent = packing.WordTokens(public_tokenizers.path(packing.VOCABULARY)), []

    class Heard:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **more):
            sent.extend(texts)
            return self.tokenizer.encode_batch_fast(texts, **more)

    for name in ("tokenizer", "bare"):
        monkeypatch.setattr(own, name, Heard(getattr(own, name, own.tokenizer)))
    own.texts(pa.array(["Haus, haus. HAUS! (Haus) Haus?", "haus; Haus: HAUS"]))
    assert sum(text.lower().count("haus") for text in sent) == 1


def test_kept_words_take_little_memory():
    own, rng = packing.WordTokens(public_tokenizers.path(packing.VOCABULARY)), random.Random(3)
    text = " ".join({"".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(20_000)})
    own.texts(pa.array(["warm up"]))
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    own.texts(pa.array([text]))
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert len(own.known.kept) > 19_000
    assert held < 100 * len(own.known.kept)


def test_pieces_are_handed_on_some_at_a_time(monkeypatch):
    monkeypatch.setattr(packing, "ROWS", 3, raising=False)
    docs = [(k, np.arange(k + 1, dtype=np.uint32)) for k in range(10)]
    batches, free = packing._run(docs, 7, tokens().closes, 16)
    batches = list(batches)
    assert len(batches) > 3 and all(1 <= b.num_rows <= 3 for b in batches)
    rows = [r for b in batches for r in b.to_pylist()]
    whole = {k: b"".join(r["ids"] for r in rows if r["doc_id"] == k) for k, _ in docs}
    assert whole == {k: t.tobytes() for k, t in docs} and {r["sequence_id"] for r in rows} == set(range(7, free))


def test_a_runs_tables_take_little_memory():
    rng, closes = np.random.default_rng(0), np.zeros(50_000, bool)
    ids = rng.integers(8, 40_000, packing.RUN).astype(np.uint32)
    ids[::13], closes[7] = 7, True
    docs = [(k, d) for k, d in enumerate(np.array_split(ids, packing.RUN // 800))]
    tracemalloc.start()
    pieces = sum(b.num_rows for b in packing._run(docs, 0, closes, packing.SIZE)[0])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pieces > len(docs) and most < 30e6
