from __future__ import annotations

import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from talkmill.llm import ppm


class PlainModel:
    """Context counts in dictionaries; prediction symbol by symbol with exclusion."""

    def __init__(self, texts, order=ppm.ORDER):
        self.order, self.counts = order, [defaultdict(Counter) for _ in range(order + 1)]
        for t in texts:
            b = b"\n" * order + t
            for p in range(order, len(b)):
                for k in range(order + 1):
                    self.counts[k][b[p - k:p]][b[p]] += 1

    def probability(self, context, symbol):
        p, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            seen = {s: n for s, n in self.counts[k].get(context[len(context) - k:], {}).items() if s not in excluded}
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if symbol in seen:
                return p * seen[symbol] / whole
            p *= len(seen) / whole
            excluded |= set(seen)
        return p / (256 - len(excluded))

    def score(self, text):
        b = b"\n" * self.order + text
        return sum(math.log10(self.probability(b[p - self.order:p], b[p])) for p in range(self.order, len(b)))


def compare(rows, got):
    words = {n: (t or "").encode().lower().split() for n, (_, t, *_) in enumerate(rows)}
    held = {n: crc32(("" if i is None else str(i)).encode()) % 10 == 0 for n, (i, *_) in enumerate(rows)}
    train = [n for n in words if not held[n]]
    counts = Counter(w for n in train for w in words[n])
    total, kinds = sum(counts.values()) + len(train), len(counts) + bool(train)
    model = PlainModel([b" ".join(words[n]) + b"\n" for n in train])
    want = []
    for n, (i, *_) in enumerate(rows):
        c = [counts[w] for w in words[n]] + [len(train)]
        base = sum(math.log10((x + 0.1) / (total + 0.1 * (kinds + 1))) for x in c)
        want.append((i, held[n], len(c), sum(x > 0 for x in c), total, base, model.score(b" ".join(words[n]) + b"\n")))
    key = lambda r: (str(r[0]), r[2], round(r[5], 3))
    for a, b in zip(sorted((tuple(r)[:7] for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6, abs=1e-5)


def test_odd_rows(odd, odd_rows, none_at_all):
    rows = odd_rows
    compare(rows, ppm.ppm_scores(odd).collect())
    assert ppm.ppm_scores(none_at_all).collect() == []


def test_small_blocks_and_folding(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 700)
    compare(odd_rows, ppm.ppm_scores(odd).collect())


def test_predictions_sum_to_one():
    model = PlainModel([b"abracadabra\n", b"abra cad\n"])
    for context in (b"\n\n\n\n\n", b"xabra", b"zzzzz", b"dabra"):
        codes = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)])
        grams = Counter()
        for t in (b"abracadabra\n", b"abra cad\n"):
            b = b"\n" * 5 + t
            grams.update(int.from_bytes(b[p - 5:p + 1], "big") for p in range(5, len(b)))
        every = np.unique(np.concatenate([codes, np.array(list(grams))]))
        counts = np.array([grams[c] for c in every.tolist()])
        pairs = np.zeros(1 << 16, np.int64)
        for g, n in grams.items():
            pairs[g & 0xFFFF] += n
        logp = ppm.log_probabilities(every, counts, pairs)[np.searchsorted(every, codes)]
        assert (10 ** logp).sum() == pytest.approx(1.0)
        assert 10 ** logp == pytest.approx([model.probability(context, s) for s in range(256)])


def test_nothing_to_learn_from(spark):
    only_held = [(i, "some words here") for i in range(400) if crc32(str(i).encode()) % 10 == 0][:3]
    compare(only_held, ppm.ppm_scores(spark.createDataFrame(only_held, "doc_id long, text string")).collect())


def test_grams_of_a_block_are_found_by_one_sort(monkeypatch):
    rng = np.random.default_rng(5)
    few = rng.integers(0, 1 << 48, 400)
    for codes in (rng.choice(few, 3000), few[:1], np.repeat(few[:2], 5), rng.integers(0, 1 << 48, 1 << 18)):
        train = rng.random(len(codes)) < 0.7
        unique, which, counts = np.unique(codes, return_inverse=True, return_counts=True)
        got, n = ppm.counted(codes, train)
        assert got.tolist() == unique.tolist() and n.tolist() == np.bincount(which, train, len(unique)).tolist()
        assert (ppm.placed(codes, unique) == which).all()
    # The hash table of numpy.unique and a binary search per gram took most of a block's time.
    monkeypatch.setattr(ppm.np, "searchsorted", None)
    monkeypatch.setattr(ppm.np, "unique", None)
    codes = rng.choice(few, 3000)
    assert (ppm.different(codes)[ppm.placed(codes, ppm.different(codes))] == codes).all()
