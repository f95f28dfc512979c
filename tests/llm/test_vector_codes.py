from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from talkmill.llm.vector_codes import DEGREE, Gnat, code_report, squares, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, point array<long>, label_of int"


def by_hand(rows, parts=4, entries=256, rounds=4):
    """The whole job in plain Python."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [(i, v + [0] * (-width % parts), lab) for i, v, lab in kept if len(v) == width]
    w = len(kept[0][1]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for c in cut:
                mine[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(mine[k]) for col in zip(*mine[k])] if k in mine else e for k, e in enumerate(books[p])]
    out, per = [], Counter()
    for (i, _, lab), c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
        per[lab] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, per[lab], digest) for i, c, e, lab in out], digest


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, [2], 3) for r in rows], SCHEMA).repartition(5)


def f32(x):
    return float(np.float32(x))


def result(spark, rows, **kw):
    codes, books = vector_codes(table(spark, rows), **kw)
    return sorted(map(tuple, code_report(codes, books).collect()), key=str)


def test_whole_job_with_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [f32(rng.gauss(0, 0.2)) for _ in range(12)], rng.choice([0, 0, 0, 1, None])) for i in range(700)]
    rows += [(i, rows[3][1], 7) for i in range(900, 980)] + [(5, rows[6][1], 1), (None, rows[8][1], None), (None, [0.0] * 12, 2)]
    rows += [(1001, None, 1), (1002, [None] + [0.5] * 11, 1), (1003, [float("nan")] * 12, 1), (1004, [float("inf")] + [0.0] * 11, 1), (1005, [-float("inf")] * 12, 1)]
    rows += [(1006, [1.0] * 8, 1), (1007, [], 1)]
    rng.shuffle(rows)
    want, _ = by_hand(rows)
    assert result(spark, rows) == sorted(want, key=str)


def test_ties_few_rows_and_uneven_lengths(spark):
    rng = random.Random(9)
    grid = [(i, [float(rng.randint(-1, 1)) / 1024 for _ in range(8)], i % 2) for i in range(400)]
    few = [(i, [f32(rng.random()) for _ in range(10)], None) for i in range(20)]
    for rows, kw in ((grid, {"entries": 40}), (few, {}), ([(1, [0.25] * 4, 1)] * 30, {}), ([(3, [], 1), (4, [], None)], {})):
        assert result(spark, rows, **kw) == sorted(by_hand(rows, **kw)[0], key=str)


def test_nothing(spark):
    assert result(spark, []) == [] and result(spark, [(1, None, 2), (2, [float("nan")], 1)]) == []


def test_large_components_are_exact_or_refused(spark):
    rows = [(i, [f32((-1) ** i * i * 1000.0)] * 8, 0) for i in range(60)]
    assert result(spark, rows) == sorted(by_hand(rows)[0], key=str)
    with pytest.raises(Exception, match="too large"):
        result(spark, [(1, [1e30] * 4, 0), (2, [0.0] * 4, 0)])


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 256), st.integers(1, 6), st.sampled_from([1, 3, 40, 5000, 10**8]))
def test_tree_finds_what_a_full_search_finds(seed, n, width, spread):
    rng = np.random.default_rng(seed)
    points, queries = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread, spread + 1, (200, width))
    where, away = Gnat(points).nearest(queries)
    full = squares(queries, points)
    assert (away == full.min(1)).all() and (where == full.argmin(1)).all()


def test_subtrees_are_left_out():
    rng = np.random.default_rng(1)
    centres = rng.integers(-10**6, 10**6, (40, 4))
    points = (centres[rng.integers(0, 40, 256)] + rng.integers(-50, 50, (256, 4))).astype(np.int64)
    tree, asked = Gnat(points), 0
    plain = tree._search

    def counted(node, distances, rows, best, where):
        nonlocal asked
        asked += len(rows) * len(node[0])
        plain(node, distances, rows, best, where)

    tree._search = counted
    tree.nearest(points + 1)
    assert asked < 256 * 256 / 3 and DEGREE < 256
