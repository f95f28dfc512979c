from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

from hypothesis import given, settings, strategies as st

from talkmill.llm.length_packing import best_boundaries, packed


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts))


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 4))
def test_boundaries_are_optimal(histogram, buckets):
    lengths, counts = zip(*sorted(histogram.items()))
    ends = best_boundaries(list(lengths), list(counts), buckets)
    best = min(
        padding(lengths, counts, [*chosen, lengths[-1]])
        for k in range(min(buckets, len(lengths))) for chosen in combinations(lengths[:-1], k)
    )
    assert len(ends) <= buckets and ends[-1] == lengths[-1] and padding(lengths, counts, ends) == best


def test_odd_rows(odd, odd_rows, none_at_all):
    got = packed(odd, buckets=4, max_length=64, budget=256).collect()
    tokens = defaultdict(int)
    for r in got:
        tokens[r.doc_id] += r.n_tokens
        assert r.n_tokens + r.padding == r.bucket <= 64 and r.start == 64 * r.piece
    want = defaultdict(int)
    for i, t, *_ in odd_rows:
        want[i] += len((t or "").encode().split()) + 1
    assert tokens == want
    places = Counter((r.bucket, r.batch, r.slot) for r in got)
    assert set(places.values()) == {1}
    for bucket in {r.bucket for r in got}:
        full = 256 // bucket
        numbers = sorted(r.batch * full + r.slot for r in got if r.bucket == bucket)
        assert numbers == list(range(len(numbers))) and all(r.slot < full for r in got if r.bucket == bucket)
    assert packed(none_at_all).collect() == []
