from __future__ import annotations

import random

import numpy as np
import xxhash

from llm_tables import table_of
from talkmill.llm import simhash_pivots as sp
from talkmill.llm.components import connected


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=3):
    """Smallest index reachable, by brute force."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_odd_rows(odd, odd_rows, none_at_all):
    got = sp.simhash_groups(odd).collect()
    prints = [plain_fingerprint(t) for _, t, *_ in odd_rows]
    groups = plain_groups(prints)
    least = {}
    for (i, *_), g in zip(odd_rows, groups):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = [(i, f"{p:016x}", least.get(g)) for (i, *_), p, g in zip(odd_rows, prints, groups)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sp.simhash_groups(none_at_all).collect() == []


def test_links_of_dense_and_random_prints(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = set(base)
    for b in base:
        for _ in range(40):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.node: r.root for r in connected(sp.linked(df)).collect()}
    groups = plain_groups(prints)
    label = {}
    for s, g in zip(signed, groups):
        label.setdefault(g, set()).add(roots.get(s, s))
    assert all(len(x) == 1 for x in label.values())
    assert len({next(iter(x)) for x in label.values()}) == len(label)


def test_pivot_bound_never_drops_a_link():
    rng = np.random.default_rng(1)
    prints = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
    table = sp.distances(prints, sp.SCATTERED)
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
    assert (np.abs(table[:, None, :] - table[None, :, :]).max(axis=2) <= apart).all()


def test_one_of_each_keeps_columns(spark, odd):
    kept = sp.one_of_each(table_of(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words here entirely")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and "fp" in kept.columns


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r.node: r.root for r in connected(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
