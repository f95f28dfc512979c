from __future__ import annotations

import random
import re
from collections import Counter

from llm_tables import sentence, table_of
from talkmill.llm import fertility
from talkmill.llm.queries import PIECES, RANKS

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def plain_base(text):
    text = text or ""
    words = [w for w in BLANK.split(text) if w]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if BLANK.sub("", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_base_columns(odd, odd_rows, none_at_all):
    got = fertility.judged(odd, PIECES, RANKS).collect()
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str)
    assert have == sorted(((i, *plain_base(t)) for i, t, *_ in odd_rows), key=str)
    assert not any(r.kept and r.base_failed for r in got)
    assert fertility.judged(none_at_all, PIECES, RANKS).collect() == []


def test_bands_reject_junk_and_keep_prose(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, 120), "en" if i % 2 else None) for i in range(240)]
    rows += [(1000 + i, " ".join("¤§¶†‡"[rng.randrange(5)] * 3 for _ in range(120)), "en" if i % 2 else None) for i in range(6)]
    rows += [(2000, rows[0][1], "en")] * 300  # copies must not narrow the bands
    kept = {r.doc_id: r.kept for r in fertility.judged(table_of(spark, rows), PIECES, RANKS).collect()}
    assert all(kept[i] for i in range(240)) and kept[2000]
    assert not any(kept[1000 + i] for i in range(6))


def test_rare_languages_have_their_own_band(spark):
    """Verdicts of a rare language do not depend on how many texts another language has."""
    rng = random.Random(4)
    rare = [(i, " ".join("".join(rng.choice("żółć gęśl ąśćń źdźb ńęłó".split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(80, 400))), "xx") for i in range(20)]
    junk = [(50, " ".join("żółć" + rng.choice("#*$%&") * rng.randint(9, 99) + str(rng.random()) for _ in range(150)), "xx")]
    common = [(1000 + i, sentence(rng, rng.randint(80, 400)), "en") for i in range(2000)]
    alone, among = ({r.doc_id: r.kept for r in fertility.judged(table_of(spark, rows), PIECES, RANKS).collect()} for rows in (rare + junk, rare + junk + common))
    assert all(among[i] for i in range(20)) and not among[50]
    assert all(among[i] == kept for i, kept in alone.items())
    assert sum(among[1000 + i] for i in range(2000)) >= 1990


def test_repeated_words_as_defined():
    import numpy as np

    assert fertility.repeated_words(np.array([1, 2, 3, 9, 1, 2, 3])) == 6
    assert fertility.repeated_words(np.array([1, 1, 1, 1])) == 4
    assert fertility.repeated_words(np.array([1, 2, 3])) == 0


def test_script():
    assert [fertility.script_of(t) for t in ("abc", "привет", "日本語", "123", "")] == ["latin", "cyrillic", "han", "other", "other"]


def test_repeated_words_of_texts_with_very_many_words():
    import numpy as np

    from talkmill.llm.fertility import repeated_words

    n = (1 << 21) + 10
    ids = np.arange(2 * n, dtype=np.int64)
    assert repeated_words(ids) == 0
    assert repeated_words(np.concatenate([ids, ids[n:n + 4]])) == 8
    assert repeated_words(np.concatenate([ids, [5, 6], [5]])) == 0
