from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from talkmill.functions import flags as G, labels as B, language as L, romanized as R, sentiment as SE, text as T
from talkmill.functions.competitors import extract_competitors

CLEANED = [
    ("<i>QUITE nice!!!!</i> more at https://shop.example/p now", "quite nice! more at now"),
    ("Great phone?????   Amazing!!!!", "great phone? amazing!"),
    ("müde Füße 🎧 heiß".encode().decode("latin-1"), "müde füße 🎧 heiß"),
    ("  Solid   Build  ", "solid build"),
    ("Three cheers for the Devs 🎉", "three cheers for the devs 🎉"),
    ("She’d never sell That console", "she’d never sell that console"),
    ("a&amp;b &lt;b&gt;x &copy;", "a&b x ©"),
    ("ﬁne ① Ｗｉｄｅ", "fine 1 wide"),
    ("go www.a.b/c?d=1 now, xwww.stays", "go now, xwww.stays"),
    ("zero​width\u0007bell�", "zerowidthbell"),
    ("tab\tand\nline sep", "tab and line sep"),
    ("new emoji 🫠 stays", "new emoji 🫠 stays"),
    ("keep ;; one,,, each..", "keep ; one, each."),
    (None, ""), ("", ""), ("   ", ""),
]


def test_clean_text(one):
    assert one([t for t, _ in CLEANED], T.clean_text) == [want for _, want in CLEANED]


def test_clean_text_is_idempotent(one):
    cleaned = [want for _, want in CLEANED if "&" not in want]
    assert one(cleaned, T.clean_text) == cleaned


def test_windows_1252_repair(one):
    assert one(["it’s fine".encode().decode("cp1252"), "â la carte"], T.clean_text) == ["it’s fine", "â la carte"]


@pytest.mark.parametrize("text, spam", [
    ("see https://one.example then https://two.example", True), ("please subscribe, a giveaway is on", True), ("🔥🔥🔥", True), ("🫠🫠", True),
    ("niiiiiiice", True), ("Aaaaaah", True), ("🔥🔥 fire 🔥🔥🔥🔥🔥🔥", True), ("www.a.com www.b.com are good sites to read about phones and cameras", True),
    ("www.only.example", True), ("www.a.example says this phone is the best one you can get for money", False),
    ("ek phone mujhe dedo na", True), ("next video comparison kudunga anna", True),
    ("fine screen, loud speakers", False), ("which one lasts longer, the old or the new", False), ("", False), ("  ", False), (None, False), ("12345", False),
])
def test_is_spam(one, text, spam):
    assert one([text], G.is_spam) == [spam]


def test_simple_flags(one):
    texts = ["ok", " ok then ", "", "   ", None, "[Deleted] ", "comment removed", "abc", "a b"]
    assert one(texts, G.is_empty) == [False, False, True, True, True, False, False, False, False]
    assert one(texts, G.is_deleted) == [False, False, False, False, False, True, True, False, False]
    assert one(texts, G.is_short) == [True, False, True, True, True, False, False, False, False]
    assert one(texts, G.is_single_word) == [True, False, False, False, False, True, False, True, False]
    assert one(["http://x", "https is", "x y", "ab", None, "🔥 🔥🔥"], G.fails_final_cleanup) == [True, True, False, True, True, True]


@pytest.mark.parametrize("text, label", [
    ("Its battery lasts long", "english"), ("बैटरी बहुत चलती है", "hindi"), ("ബാറ്ററി നല്ലതാണ് കേട്ടോ", "malayalam"),
    ("yaar battery bahut strong hai", "hinglish"), ("🎉🎉🎉", "unknown"), ("nice बैटरी", "mixed_hindi_english"),
    ("பேட்டரி lasts நீண்ட", "mixed_tamil_english"), ("బ్యాటరీ lasts చాలా", "mixed_telugu_english"), ("ব্যাটারি lasts অনেক", "mixed_bengali_english"),
    ("this chetta is here", "romanized_malayalam"), ("যহ যহ தமிழ்", "mixed_tamil_bengali"), ("привет", "unknown"), (None, "unknown"), ("", "unknown"),
    ("ଓଡ଼ିଆ text", "english"), ("यह এই ఈ phone", "mixed_bengali_hindi_telugu"),
])
def test_detect_language(one, text, label):
    assert one([text], L.detect_language) == [label]


def test_script_codes(one):
    texts = ["привет мир", "مرحباً بالعالم", "यह फोन", "hello", "ж", "hello hello hello hello ж ж", "Ελληνικά ж", None]
    assert one(texts, L.detect_script_code) == ["rus_Cyrl", "ara_Arab", "hin_Deva", None, None, None, None, None]


def test_similarity(one):
    assert one(["abc", "", " ", "a", "night"], lambda c: T.bigram_jaccard(c, F.lit("abc"))) == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert one(["", "x"], lambda c: T.bigram_jaccard(c, c)) == [1.0, 1.0]
    assert one(["night"], lambda c: T.bigram_jaccard(c, F.lit("nacht"))) == [1 / 7]
    assert one(["🔥🙂a"], lambda c: T.bigram_jaccard(c, F.lit("🔥🙂b"))) == [1 / 3]


def test_slug_words_titles(one):
    assert one(["Nintendo Switch", " !! ", "iPhone-17 Pro"], T.product_slug) == ["nintendo_switch", "product", "iphone_17_pro"]
    assert one(["a  b c", "", "  x "], T.word_count) == [3, 0, 1]
    assert one(["don't stop", "future demand"], T.title_case) == ["Don'T Stop", "Future Demand"]
    assert one([" 42 ", "-7", "4.5", "x", "", None], B.safe_long) == [42, -7, None, None, None, None]


def test_rule_sentiment(one):
    texts = ["good", "not good", "very good", "not bad", "very bad", "so so", "never 5g good", "été good", "goods", "", None, "don't love", "super good"]
    assert one(texts, SE.sentiment_score) == [1, -1, 2, 1, -2, 0, -1, 1, 0, 0, 0, 1, 3]
    assert one(["good", "bad", "x"], SE.rule_sentiment) == ["Positive", "Negative", "Neutral"]


def test_competitors(one):
    def names(product):
        return lambda c: F.array_sort(extract_competitors(c, F.lit(product)))

    assert one(["the 16 pro beats my pixel and the switch"], names("Iphone 17")) == [["16 pro", "Pixel", "Switch"]]
    assert one(["my steam deck"], names("Steam Deck")) == [["Steam Deck"]]
    assert one(["my steam deck"], lambda c: extract_competitors(c, F.lit("Steam Deck"), exclude_self=True)) == [[]]
    assert one(["rog ally", None], names("Other phone")) == [["Rog Ally"], []]


def test_romanized_dictionary(one):
    words = {"bahut": "very", "accha hai": "is good", "accha": "good", "hai": "is", "kitna": "how much"}
    assert one(["Bahut accha hai", "kitna, Accha!", "hairy", "  "], lambda c: R.normalize_romanized(c, words)) == ["very is good", "how much, good!", "hairy", "  "]
    assert one(["hai a b c d e f", "hai a", "", None], lambda c: R.is_dictionary_dominated(c, words)) == [False, True, False, False]


def test_labels(one):
    assert one([" positive", "", None, "NEUTRAL"], B.normalize_sentiment_label) == ["Positive", "Neutral", "Neutral", "Neutral"]
    assert one(["Purchase Intent"], B.label_key) == ["purchase_intent"]
    assert one(["0", "1", "7", "100000"], lambda c: B.like_weight(c.cast("bigint"))) == [1.0, 2.0, 4.0, 10.0]


def test_numbers_and_timestamps_in_common_formats(one):
    assert one(["1d", "5f", "3D", " 4.5 ", "1e3", ".5", "7.", "x", "", None], B.coerce_numeric) == [None, None, None, 4.5, 1000.0, 0.5, 7.0, None, None, None]
    good = ["2024-01-05", "2024-01-05T10:00:00Z", "2024/01/05", "2024/1/5 10:00", "Jan 5, 2024", "05-01-2024 10:00", "20240105",
            "Mon, 05 Jan 2024 10:00:00 GMT", "1/5/2024", "5 Jan 2024"]
    bad = ["someday", "", "2024-13-45", "20241345", "1/45/2024", "Foo 5, 2024"]
    assert one(good, G.is_invalid_timestamp) == [False] * len(good)
    assert one([*bad, None], G.is_invalid_timestamp) == [True] * len(bad) + [False]


def test_bigrams_are_compared_without_strings_of_their_own(spark, monkeypatch):
    import random

    from talkmill.functions import bigrams as B

    rng = random.Random(3)
    texts = ["".join(rng.choices(rng.choice(["ab ", "abcdefgh", "aäß🙂", "語字文𐍈x"]), k=rng.choice([0, 1, 2, 3, 40, 300]))) for _ in range(400)]
    pairs = [*zip(texts[::2], texts[1::2]), ("", "x"), ("x", "y"), ("", ""), (None, "x"), ("x", None), ("A  B", " a b ")]

    def plain(a, b):
        if a is None or b is None:
            return None
        a, b = " ".join(a.lower().split()), " ".join(b.lower().split())
        x, y = ({t[i:i + 2] for i in range(len(t) - 1)} for t in (a, b))
        return 1.0 if a == b else 0.0 if not a or not b else len(x & y) / len(x | y) if x | y else 1.0

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    scored = df.select("i", T.bigram_jaccard(F.col("a"), F.col("b")).alias("s"))
    assert "regexp_extract_all" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert [r.s for r in scored.orderBy("i").collect()] == [plain(*p) for p in pairs]
    long = [(a, b) for a, b in pairs if a and b]
    encoded = [[t.encode() for t in side] for side in zip(*long)]
    monkeypatch.setattr(B, "CHUNK", 50)
    assert [x for part in B._compared(*encoded) for x in part] == B.shares(*encoded).tolist()
    assert B.shares([b"a\xffb", b"ab"], [b"a\xffc", b"ab\xff"]).tolist() == [1 / 3, 1 / 2]
