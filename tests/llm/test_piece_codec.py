from __future__ import annotations

import hashlib
import random

import sentencepiece
from hypothesis import given, settings, strategies as st

from talkmill.llm.piece_codec import PieceCodec, PieceTable, decoded, digests, encoded, piece_table
from talkmill.llm.queries import PIECES

MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)
CODEC = PieceCodec(piece_table(PIECES))
PARTS = list("abcdehinorst  \n\t.,éßñ日▁①🙂�<>|01\x00 ​ａ") + ["the", "tion", "   ", "</s>", "<unk>", "<0x41>", " ▁ ", "े", "é"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join))
def test_ids_and_text_as_the_library(text):
    want = MODEL.encode(text, add_eos=True)
    assert CODEC.encode(text, end=True).tolist() == want
    assert CODEC.decode(want) == MODEL.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80).filter(lambda t: not any("\ud800" <= c <= "\udfff" for c in t)))
def test_any_characters(text):
    ids = CODEC.encode(text, end=True).tolist()
    assert ids == MODEL.encode(text, add_eos=True) and CODEC.decode(ids) == MODEL.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 31999) | st.integers(1, 260), max_size=30))
def test_any_ids_decode_as_the_library(ids):
    assert CODEC.decode(ids) == MODEL.decode(ids)


def test_long_words_and_runs():
    rng = random.Random(3)
    for text in ("a" * 5000, " " * 700 + "x", "".join(rng.choice("abtheion") for _ in range(20_000)), "日本語" * 3000, "🙂" * 999):
        ids = CODEC.encode(text).tolist()
        assert ids == MODEL.encode(text) and CODEC.decode(ids) == text


def by_merging(word: str, ranks: dict[str, int]) -> list[str]:
    parts = list(word)
    while True:
        merges = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not merges:
            return parts
        k = min(merges)[1]
        parts[k:k + 2] = [parts[k] + parts[k + 1]]


def test_own_vocabularies_against_plain_merging():
    """Random vocabularies: equal scores, pieces that merging never reaches, letters that are no piece."""
    rng = random.Random(8)
    for _ in range(60):
        letters = "abc"
        pieces = {"".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(1, 14))} | set(rng.sample(letters, 2))
        table = PieceTable([(p, -float(rng.randint(1, 6)), 300 + k) for k, p in enumerate(sorted(pieces))], list(range(256)), 299)
        codec, ids = PieceCodec(table), {p: 300 + k for k, p in enumerate(sorted(pieces))}
        for _ in range(30):
            word = "".join(rng.choice(letters + "x") for _ in range(rng.randint(1, 14)))
            want = [i for part in by_merging(word, codec.ranks) for i in ([ids[part]] if part in ids else part.encode())]
            assert codec.encode_word(word) == want, (word, pieces)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(odd, odd_rows, none_at_all):
    rows = encoded(odd, PIECES)
    want = []
    for i, t, *_ in odd_rows:
        ids = MODEL.encode(t or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(MODEL.decode(ids))))
    assert sorted(map(tuple, digests(rows).collect()), key=str) == sorted(want, key=str)
    again = decoded(rows, PIECES, into="again").collect()
    assert all(r.again == r.decoded for r in again) and len(again) == len(odd_rows)
    assert encoded(none_at_all, PIECES).collect() == []
