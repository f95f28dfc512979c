from __future__ import annotations

import random

import sentencepiece
from hypothesis import given, settings, strategies as st

from talkmill.llm.queries import PIECES
from talkmill.llm.token_counts import PieceMerger, piece_ranks, token_counts

MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)
MERGER = PieceMerger(piece_ranks(PIECES))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(list("abcdehinorst  \n\t.,éßñ日▁①🙂�<>|01") + ["the", "tion", "   ", "</s>", "<unk>", "<0x41>"]), max_size=60).map("".join))
def test_as_the_library(text):
    assert MERGER.count(text) == len(MODEL.encode(text))


def test_long_words_and_runs():
    rng = random.Random(3)
    for text in ("a" * 5000, " " * 700 + "x", "".join(rng.choice("abtheion") for _ in range(20_000))):
        assert MERGER.count(text) == len(MODEL.encode(text))


def test_odd_rows(odd, odd_rows, none_at_all):
    got = token_counts(odd, PIECES, limit=500).collect()
    want = [(i, len((t or "").encode()), len(MODEL.encode(t or "")), len(MODEL.encode(t or "")) > 500) for i, t, *_ in odd_rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(none_at_all, PIECES).collect() == []
