from __future__ import annotations

import random

import pytest

import corpus_pipeline as cp
from llm_tables import sentence, table_of
from talkmill.llm import near_copies
from talkmill.llm.simhash_pivots import fingerprint


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_stage_takes_near_copies_at_eight_tenths(spark):
    """Near copies whose lines are broken anew, so that line dedup does not see them."""
    rng = random.Random(8)
    rows = []
    for i in range(30):
        words = sentence(rng, 200).split()
        rows.append((10 * i, " ".join(words)))
        near = list(words)
        for at in (40, 120) if i % 2 else (20, 60, 100, 140, 170):
            near[at] = "changed"
        rows.append((10 * i + 1, "\n".join(" ".join(near[k:k + 9]) for k in range(0, 200, 9))))
        rows.append((10 * i + 2, " ".join(words[:100]) + " " + sentence(rng, 100)))
    want = {i for i, t in rows if not any(j < i and jaccard(plain_shingles(t), plain_shingles(u)) >= 0.8 for j, u in rows if i // 10 == j // 10)}
    assert sum(i % 10 == 1 for i in want) == 15 and sum(i % 10 == 2 for i in want) == 30
    assert {r.doc_id for r in cp.near_duplicates(spark, table_of(spark, rows), "").collect()} == want


def test_odd_rows(odd, odd_rows, none_at_all):
    got = sorted(map(tuple, near_copies.near_copy_groups(odd).collect()), key=str)
    sets = [plain_shingles(t) for _, t, *_ in odd_rows]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    ids = [i for i, *_ in odd_rows]
    least = {r: min((i for i, q in zip(ids, root) if q == r and i is not None), default=None) for r in root}
    assert got == sorted(((i, least[r]) for i, r in zip(ids, root)), key=str)
    assert near_copies.near_copy_groups(none_at_all).collect() == []


def test_candidates_come_from_the_pivot_tables(spark, monkeypatch):
    rng = random.Random(12)
    base = [sentence(rng, 400) for _ in range(6)]
    texts = [*base, *(b.rsplit(" ", 1)[0] + " changed" for b in base), *(b + " !" for b in base)]
    monkeypatch.setattr(near_copies, "bands_of", lambda found: [])
    prints = [int.from_bytes(fingerprint(t)) for t in texts]
    want = [min(j for j in range(18) if i % 6 == j % 6 and (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(18)]
    assert sum(w != i for i, w in enumerate(want)) >= 6
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.near_copy_groups(df).collect()}
    assert all(got[i] == got[w] for i, w in enumerate(want))


def grouped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [r.component_id for r in sorted(near_copies.near_copy_groups(df).collect())]


def brute_groups(texts, candidate=lambda i, j: True):
    sets, root = [plain_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if candidate(i, j) and jaccard(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def families(rng, n):
    """Families of five: each text is near the one before, not always near the first; families in mixed order."""
    texts = []
    for _ in range(n):
        words = sentence(rng, 80).split()
        for _ in range(5):
            words = [*words[:-3], *sentence(rng, 3).split()] if rng.random() < 0.7 else [sentence(rng, 1), *words[:-1]]
            texts.append(" ".join(words))
            words = [*words[3:], *sentence(rng, 3).split()]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block_bytes", [near_copies.BLOCK_BYTES, 4000])
def test_all_texts_of_a_fingerprint_are_compared(spark, monkeypatch, block_bytes):
    texts = families(random.Random(21), 8)
    monkeypatch.setattr(near_copies, "bands_of", lambda found: [])
    monkeypatch.setattr(near_copies, "fingerprint", lambda text: bytes(8))
    monkeypatch.setattr(near_copies, "BLOCK_BYTES", block_bytes)
    want = brute_groups(texts)
    assert len(set(want)) in range(8, 30)
    assert grouped(spark, texts) == want


def test_all_pairs_within_the_radius_are_compared(spark, monkeypatch):
    rng = random.Random(22)
    texts = families(rng, 8)
    prints = {t: sum(1 << b for b in rng.sample(range(12), rng.randint(0, 5))) for t in texts}
    monkeypatch.setattr(near_copies, "bands_of", lambda found: [])
    monkeypatch.setattr(near_copies, "fingerprint", lambda text: prints[text].to_bytes(8))
    want = brute_groups(texts, lambda i, j: (prints[texts[i]] ^ prints[texts[j]]).bit_count() <= 3)
    assert want != brute_groups(texts)
    assert grouped(spark, texts) == want


def test_all_texts_of_a_band_are_compared(spark, monkeypatch):
    rng = random.Random(23)
    texts = families(rng, 8)
    prints = {t: rng.getrandbits(64).to_bytes(8) for t in texts}
    monkeypatch.setattr(near_copies, "bands_of", lambda found: [int(found[0] % 2), 7, *range(2, near_copies.BANDS)])
    monkeypatch.setattr(near_copies, "fingerprint", lambda text: prints[text])
    assert grouped(spark, texts) == brute_groups(texts)
