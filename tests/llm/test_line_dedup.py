from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_tables import sentence, table_of
from talkmill.llm import line_dedup
from talkmill.llm.line_dedup import line_report, repeated_lines, without_repeats


def plain(rows):
    """(doc, line) of every line that an earlier line matches, by comparing all lines."""
    lines = [
        (i, n, frozenset(x.encode().lower().split())) for i, t in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda r: r[0])
        for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\x0b\x0c\r")
    ]
    lines.sort(key=lambda x: x[:2])
    return {
        (i, n) for k, (i, n, w) in enumerate(lines)
        if any(5 * len(w & v) >= 4 * len(w | v) and (j, m) != (i, n) for j, m, v in lines[:k])
    }


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else sentence(rng, 1) for w in text.split(" "))


@pytest.fixture(scope="module")
def similar():
    """One line with many near copies, others with few, short lines."""
    rng = random.Random(8)
    hot, rows = sentence(rng, 25), []
    for i in range(120):
        lines = [edited(rng, hot, 0.08) for _ in range(2)] + [sentence(rng, rng.randint(1, 12)) for _ in range(3)] + ["the end"] * (i % 3)
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, edited(rng, rows[i][1], 0.05)) for i in range(30)]
    return rows


def test_all_links_found(spark, similar):
    got = repeated_lines(table_of(spark, similar).repartition(4)).collect()
    assert {(r.doc, r.line) for r in got} == plain(similar) and len(got) == len(plain(similar))


def test_failed_first_candidates_are_followed_up(spark, similar, monkeypatch):
    # Without the bitmap bound most first candidates fail, and the rest of a list has to be searched.
    monkeypatch.setattr(line_dedup, "bits_differ", lambda bits, y, x: y * 0)
    monkeypatch.setattr(line_dedup, "SHORT", 2)
    monkeypatch.setattr(line_dedup, "ENOUGH", 1)
    got = repeated_lines(table_of(spark, similar).repartition(4)).collect()
    assert {(r.doc, r.line) for r in got} == plain(similar)


def test_odd_rows(spark, odd, odd_rows, none_at_all):
    got = {(r.doc, r.line) for r in repeated_lines(odd).collect() if r.doc >= 0}
    assert got == {(i, n) for i, n in plain(odd_rows)}
    report = line_report(odd).collect()
    assert len(report) == len(odd_rows)
    by_id = {r.doc_id: r for r in report if r.doc_id not in (None, 5)}
    assert all(list(by_id[i].removed) == sorted(n for j, n in got if j == i) for i in by_id)
    assert by_id[100].n_lines == 0 and by_id[111].n_lines == 4
    assert repeated_lines(none_at_all).collect() == [] and without_repeats(none_at_all).collect() == []


def test_texts_without_repeats(spark):
    rows = [(1, "alpha beta gamma\n\ndelta epsilon"), (2, "ALPHA  beta gamma\nzeta eta theta"), (3, "alpha beta gamma"), (4, None), (5, " \n "), (6, "eta zeta\ntheta")]
    df = table_of(spark, rows)
    out = without_repeats(df)
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "zeta eta theta", 4: None, 5: " \n ", 6: "eta zeta\ntheta"}
    assert out.columns == df.columns
    assert {r.doc_id for r in without_repeats(df, drop_emptied=False).collect()} == {1, 2, 3, 4, 5, 6}


def test_texts_with_more_lines_than_packed_numbers_hold():
    from talkmill.llm.line_dedup import Lines

    n = (1 << 21) + 5
    lines = Lines([7], ["\n".join(f"w{i} x" for i in range(n))])
    alone = Lines([7], [f"w{n - 1} x\nw0 x\nw4 x"]).digests()
    digests = lines.digests()
    assert (digests[[n - 1, 0, 4]] == alone).all() and len(lines.n) == n and (lines.n == 2).all()


def test_texts_that_share_an_id(spark):
    """No line goes without a match, and each text loses its own lines."""
    rows = [(1, "first words of all\nshared line number one here"), (2, "zzz yyy xxx www\nshared line number one here"), (2, "some other text entirely good\nkeep this second line of another text"),
            (2, "zzz yyy xxx www\nshared line number one here"), (3, "keep this second line of another text\nown line of three"), (-4, "own line of three"), (None, "qqq ppp ooo"), (None, "nothing like it")]
    out = sorted(((r.doc_id, r.text) for r in without_repeats(table_of(spark, rows)).collect()), key=str)
    assert out == sorted([(1, rows[0][1]), (2, "zzz yyy xxx www"), (2, rows[2][1]), (2, "zzz yyy xxx www"), (-4, "own line of three"), (None, "qqq ppp ooo"), (None, "nothing like it")], key=str)
    removed = {(r.doc_id, r.n_lines, tuple(r.removed)) for r in line_report(table_of(spark, rows)).collect()}
    assert (2, 2, (1,)) in removed and (2, 2, ()) in removed and (3, 2, (0, 1)) in removed and (1, 2, ()) in removed


def test_words_are_told_apart_and_lines_chosen():
    """Hashes read eight bytes at a time: bytes behind a word, its length and long words count as they should."""
    rng = random.Random(3)
    for _ in range(60):
        words = ["".join(rng.choice("ab\0é") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 40, 255, 256, 257, 264, 900]))) for _ in range(12)]
        texts = ["\n".join(rng.choice(" \t").join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(6)) for _ in range(3)] + [None]
        sets = {(k, i): frozenset(x.encode().lower().split()) for k, t in enumerate(texts) for i, x in enumerate((t or "").split("\n")) if x.split()}
        for chosen in (None, lambda doc, line: (doc + line) % 3 == 0, lambda doc, line: doc < 0):
            lines = line_dedup.Lines([0, 1, 2, 3], texts, chosen)
            names = list(zip(lines.doc.tolist(), lines.number.tolist()))
            assert names == [k for k in sets if chosen is None or chosen(*k)]
            own = [frozenset(lines.hash[s:s + n].tolist()) for s, n in zip(lines.start, lines.n)]
            assert [len(w) for w in own] == lines.n.tolist()
            assert all((sets[a] & sets[b] == frozenset()) == (not v & w) and len(sets[a] & sets[b]) == len(v & w) for a, v in zip(names, own) for b, w in zip(names, own))


def test_orders_that_do_not_fit_packed_numbers():
    rng = np.random.default_rng(4)
    line = np.sort(rng.integers(0, 20, 500))
    for far in (0, 1 << 45, 1 << 58):
        for hashes in (rng.integers(0, 1 << 62, 500), rng.integers(0, 4, 500), (1 << 60) + rng.integers(0, 4, 500)):
            assert (hashes[line_dedup.order_by_hash(line + far, hashes)] == hashes[np.lexsort((hashes, line))]).all()
            key = hashes & 3
            assert (line_dedup.order_by(line + far, key, 2) == np.lexsort((key, line))).all()


def test_equal_lines_of_several_tasks_look_for_no_partners(spark):
    """Failed before: a line with an equal one before it was paired and verified wherever its task met a copy."""
    rng = random.Random(6)
    texts = [sentence(rng, 30) for _ in range(20)]
    rows = [(k * 100 + i, edited(rng, t, 0.05) if k == 7 else t) for k in range(8) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = table_of(spark, rows).select(F.col("doc_id").alias("doc"), "text").repartition(8)
    rarity = spark.sparkContext.broadcast(np.zeros(line_dedup.BUCKETS, np.uint8))
    packets = line_dedup._postings(docs, rarity, 4).repartition(4, "slot").sortWithinPartitions("slot")
    pairs = packets.mapInArrow(line_dedup._candidates(False), "doc long, line long, of_doc long, of_line long, word long").collect()
    later = {i for i, _ in rows if 100 <= i < 700}
    assert pairs and not any(r.doc in later or r.of_doc in later for r in pairs)
    got = {(r.doc, r.line) for r in repeated_lines(table_of(spark, rows).repartition(8)).collect()}
    assert got == plain(rows)
