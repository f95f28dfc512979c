"""Keyword and phrase tables against plain searching."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from talkmill.checks import all_queries, matching_queries  # noqa: F401
from talkmill.checks.bindings import Tables
from talkmill.functions import keywords as K, romanized as R
from talkmill.functions.keywords import leftmost_longest
from talkmill.operators import matching as M

WORD = r"[^\W]"


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, t string").repartition(3)


def table(spark, rows, schema="keyword string"):
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def made(rng, n, letters="ab c"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("set_bytes", [M.SET_BYTES, 60])
@pytest.mark.parametrize("whole", [False, True])
def test_find_and_mark_against_plain_search(spark, whole, set_bytes):
    rng = random.Random(3)
    values = [*made(rng, 120), None, "", "AB ab", "ab_c", "ä-ab", "ab" * 500]
    keywords = sorted({w for w in made(rng, 60, "abc ") if w.strip()} | {"ab", "c", "b c"})

    def occurs(word, text):
        if not whole:
            return word in text.lower()
        return re.search(rf"(?<!{WORD}){re.escape(word)}(?!{WORD})", text.lower()) is not None

    want = {(i, w) for i, t in enumerate(values) if t is not None for w in {k.lower() for k in keywords} if occurs(w, t)}
    df, words = texts(spark, values), table(spark, [*keywords, None, "", "AB"])
    got = M.find_keywords(df, words, ["id"], "t", whole_words=whole, set_bytes=set_bytes).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    marked = M.mark_keywords(df, words, "hit", "t", "id", whole_words=whole, set_bytes=set_bytes).collect()
    assert {r.id for r in marked if r.hit} == {i for i, _ in want} and len(marked) == len(values)


def replaced(text, entries):
    """Scanning from left to right, longest entry first."""
    if text is None or not text.strip():
        return text
    low, out, at = text.lower(), [], 0
    while at < len(low):
        for k in sorted(entries, key=len, reverse=True):
            end = at + len(k)
            if low.startswith(k, at) and not (at and re.match(WORD, low[at - 1])) and not (end < len(low) and re.match(WORD, low[end])):
                out.append(entries[k])
                at = end
                break
        else:
            out.append(low[at])
            at += 1
    return "".join(out)


@pytest.mark.parametrize("set_bytes", [M.SET_BYTES, 50])
def test_overlapping_phrases(spark, set_bytes):
    rng = random.Random(6)
    entries = {w.strip(): f"<{i}>" for i, w in enumerate(made(rng, 80, "ab  ")) if w.strip()}
    entries |= {"a b": "X", "b a": "Y", "a b a": "Z", "b": r"\1$", "c++": "cpp"}
    values = [*made(rng, 150, "ab  c"), None, "", "  ", "A b A b", "xa b", "c++ c+++", "a\tb"]
    df = texts(spark, values)
    for dictionary in (entries, table(spark, list(entries.items()), "source string, english string")):
        got = M.replace_phrases(df, dictionary, "t", "new", "id", set_bytes).collect()
        assert {r.id: r.new for r in got} == {i: replaced(t, entries) for i, t in enumerate(values)}
    shares = M.mark_dominated(df, table(spark, list(entries.items()), "source string, english string"), "t", "d", "id", set_bytes=set_bytes).collect()
    assert {r.id: r.d for r in shares} == {
        i: bool(t and t.split()) and sum(w in entries for w in t.lower().split()) / len(t.split()) >= 0.15 for i, t in enumerate(values)}


def test_leftmost_longest():
    assert leftmost_longest([(2, 9, "c"), (0, 3, "a"), (0, 5, "b"), (5, 6, "d"), (5, 5, "")])[0] == (0, 5, "b")
    assert leftmost_longest([]) == []


def test_dictionary_of_fifty_thousand_entries(spark):
    entries = {f"word{i}": f"w{i}" for i in range(40_000)} | {f"word{i} word{i + 1}": f"p{i}" for i in range(20_000)}
    df = texts(spark, ["word5 word6 word7", "word39999 word1", "Word20000, word19999 word20000!"])
    got = df.select("id", R.normalize_romanized(F.col("t"), entries).alias("new")).collect()
    assert {r.id: r.new for r in got} == {0: "p5 w7", 1: "w39999 w1", 2: "w20000, p19999!"}
    shares = df.select("id", R.is_dictionary_dominated(F.col("t"), entries).alias("d")).collect()
    assert all(r.d for r in shares)


def test_time_does_not_follow_the_number_of_keywords(spark):
    rng = random.Random(1)
    df = texts(spark, [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(300)) for _ in range(300)]).cache()
    df.count()

    def spent(n):
        words = spark.range(n).select(F.concat(F.lit("q"), F.col("id")).alias("keyword"))
        own = next(M.keyword_sets(words))
        df.where(own.occurs(F.col("t"))).count()  # automata are built
        started = time.time()
        for _ in range(3):
            df.where(own.occurs(F.col("t"))).count()
        return time.time() - started

    assert spent(100_000) < 5 * spent(10) + 1


def test_features_and_competitors(spark):
    df = spark.createDataFrame([
        (1, "P", "the camera and CAMERA, zoom bad"), (2, "P", "good zoom"), (3, "Q", "xbox or ps5? good bad battery"), (4, "Q", None), (5, None, "switch camera"),
    ], "id long, product_query string, t string")
    features = table(spark, [("photo", "camera"), ("photo", "zoom"), ("power", "battery"), ("none", "nowhere"), ("photo", "camera")], "feature string, keyword string")
    got = {(r.product_query, r.feature): r.n for r in M.feature_rows(df, features, ["product_query"], "t").collect()}
    assert got == {("P", "photo"): 3, ("Q", "power"): 1, (None, "photo"): 1}
    for set_bytes in (M.SET_BYTES, 30):
        sentiments = M.feature_sentiments(df, features, table(spark, ["good"]), table(spark, ["bad", "worse"]), "id", "t", set_bytes)
        assert {tuple(r) for r in sentiments.collect()} == {("photo", 1, 1), ("power", 1, 1), ("none", 0, 0)}
    rivals = table(spark, [("P", "zoom"), ("Q", "xbox"), (None, "switch"), (None, "ps5"), ("Q", "camera"), (None, "3ds")], "product string, keyword string")
    names = M.competitors(df, rivals, ["id"], text="t").collect()
    assert {(r.id, r.competitor) for r in names} == {(1, "Zoom"), (2, "Zoom"), (3, "Xbox"), (3, "Ps5"), (5, "Switch")}


def test_several_sets_need_a_key(spark):
    df, words = texts(spark, ["a"]), table(spark, [f"k{i}" for i in range(50)])
    with pytest.raises(ValueError, match="key column"):
        M.mark_keywords(df, words, "hit", "t", set_bytes=40)
    assert M.find_keywords(df, table(spark, []), ["id"], "t").collect() == []
    assert [r.hit for r in M.mark_keywords(df, table(spark, []), "hit", "t").collect()] == [False]


def test_larger_tables_are_made_once_and_blocks_are_met_alone(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_BYTES", 200)
    made_rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for rows in batches:
            made_rows.add(len(rows))
            yield rows

    words = spark.range(400).select(F.concat(F.lit("k"), F.col("id")).alias("keyword")).mapInPandas(counted, "keyword string")
    values = [f"k{i} xk{i + 1}" for i in range(300)] + [None, "", "same k7"] + ["same k7"] * 20
    got = M.find_keywords(texts(spark, values), words, ["id"], "t", whole_words=True, set_bytes=60).collect()
    assert sorted(map(tuple, got)) == sorted([(i, f"k{i}") for i in range(300)] + [(i, "k7") for i in range(302, 323)])
    assert made_rows.value == 400


def test_rows_that_share_a_key_are_judged_by_their_own_text(spark):
    df = spark.createDataFrame([(1, "a k5 b"), (1, "none"), (None, "k6"), (None, None)], "id long, t string")
    words = spark.range(50).select(F.concat(F.lit("k"), F.col("id")).alias("keyword"))
    got = M.mark_keywords(df, words, "hit", "t", "id", set_bytes=60).collect()
    assert sorted((r.t or "", r.hit) for r in got) == [("", False), ("a k5 b", True), ("k6", True), ("none", False)]


def test_keywords_of_blanks_signs_and_parts_of_words(spark):
    values = ["a  b", "xfoo bary", "foo bar", "\U0001f525\U0001f525!", "a-\U0001f525", "日本語テキスト", " ", "a" * 70 + "b"]
    keywords = ["  ", " ", "foo bar", "\U0001f525", "本語", "-", "a" * 30 + "b", "!", "a-"]
    df, words = texts(spark, values), table(spark, keywords)
    for whole in (False, True):
        small, large = ({tuple(r) for r in M.find_keywords(df, words, ["id"], "t", whole_words=whole, set_bytes=n).collect()} for n in (M.SET_BYTES, 10))
        assert small == large and len(small) > 5


def test_query_whose_table_is_larger_than_a_set(spark, monkeypatch):
    query, _ = all_queries()["keyword_table_filter"]
    t = Tables(spark, "/root/testdata/sf0.001")
    one_set = sorted(map(tuple, query(t).collect()))
    monkeypatch.setattr(M.mark_keywords, "__defaults__", (*M.mark_keywords.__defaults__[:-1], 1000))
    assert sorted(map(tuple, query(t).collect())) == one_set


def test_whole_words_and_phrases_are_looked_up_by_runs():
    assert K.Finder({"ab": "1", "ab c": "2", "é_1 - ж": "3", "x y z": "4"}, True).automaton is None
    assert len(K.Finder({"ab": "1", "a b c d": "2", "c++": "3"}, True).automaton) == 2
    assert len(K.Finder({"ab": "1"}, False).automaton) == 1
    rng, letters = random.Random(9), "aé_1 -!ж  "
    for _ in range(400):
        entries = {k.strip(): f"<{i}>" for i in range(rng.randint(0, 20)) if (k := "".join(rng.choices(letters, k=rng.randint(1, 9)))).strip()}
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        want = {(m.start(), m.start() + len(k), v) for k, v in entries.items() for m in re.finditer(rf"(?<!{WORD})(?={re.escape(k)}(?!{WORD}))", text)}
        finder = K.Finder(entries, True)
        assert sorted(finder.spans(text)) == sorted(want)
        assert K.values_found(text, finder) == sorted({v for *_, v in want}) and K.any_found(text, finder) == bool(want)
        assert K.all_replaced(text, finder) == (replaced(text, entries) if text.strip() else text)


def test_found_keywords_come_back_without_their_texts(spark):
    found = M.find_keywords(texts(spark, ["a k5 b", "k6", None]), table(spark, [f"k{i}" for i in range(50)]), ["id"], "t", whole_words=True, set_bytes=60)
    assert sorted(map(tuple, found.collect())) == [(0, "k5"), (1, "k6")]
    assert "_text" not in found._jdf.queryExecution().analyzed().toString()
