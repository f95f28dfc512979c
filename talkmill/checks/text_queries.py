"""Row-wise functions: cleaning, flags, languages, labels, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill import schemas as S
from talkmill.checks import sql as Q
from talkmill.checks.bindings import lit
from talkmill.checks.registry import register
from talkmill.functions import flags as G, labels as B, language as L, lexicons as X, romanized as R, text as T, unicode_repair as U
from talkmill.operators import cleaning as C, learning, terms


def raw():
    return F.col("comment_text")


def _on_comments(name, column, sql_expr, out, sql_source="comment_text"):
    """One function over all comments."""
    register(
        name, lambda t: t.comments.select("comment_id", column().alias(out)),
        Q.with_comments(f"SELECT comment_id, {sql_expr} AS {out} FROM comments"),
    )


# --- cleaning -----------------------------------------------------------------
register(
    "clean_text", lambda t: t.comments.select("comment_id", T.clean_text(raw()).alias("cleaned")),
    Q.with_comments(f"SELECT comment_id, {Q.clean('comment_text')} AS cleaned FROM comments"),
)
register(
    "normalize_unicode", lambda t: t.pages.select("page_id", U.normalize_unicode(F.col("html")).alias("decoded")),
    f"SELECT page_id, {Q.decode_entities('html')} AS decoded FROM pages",
)
register(
    "repair_mojibake",
    # A text read as Latin-1 by mistake and the text itself must both end up as the text.
    lambda t: t.documents.select(
        "doc_id", U.repair_mojibake(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).alias("repaired"),
        U.repair_mojibake(F.col("text")).alias("untouched"),
    ),
    "SELECT doc_id, text AS repaired, text AS untouched FROM documents",
)
_on_comments("remove_unreadable", lambda: T.remove_unreadable(F.concat(F.lit("\u200b\x07"), raw(), F.lit("\ufeff\n"))),
             Q.unreadable(f"{lit(chr(0x200b))} || chr(7) || comment_text || {lit(chr(0xfeff))} || chr(10)"), "readable")
register(
    "remove_html", lambda t: t.pages.select("page_id", T.remove_html(F.col("html")).alias("plain")),
    f"SELECT page_id, {Q.no_html('html')} AS plain FROM pages",
)
_on_comments("remove_urls", lambda: T.normalize_whitespace(T.remove_urls(raw())), Q.whitespace(Q.no_urls("comment_text")), "no_urls")
_on_comments("collapse_punctuation", lambda: T.collapse_punctuation(raw()), Q.punctuation("comment_text"), "collapsed")
_on_comments("normalize_whitespace", lambda: T.normalize_whitespace(raw()), Q.whitespace("comment_text"), "spaced")
_on_comments("word_count", lambda: T.word_count(raw()), Q.hits("comment_text", rf"[^{Q._WS}]+"), "words")

# --- flags --------------------------------------------------------------------
_on_comments("is_empty", lambda: G.is_empty(T.clean_text(raw())), Q.is_empty(Q.clean("comment_text")), "flag")
_on_comments("is_deleted", lambda: G.is_deleted(raw()), Q.is_deleted("comment_text"), "flag")
_on_comments("is_short", lambda: G.is_short(raw()), Q.is_short("comment_text"), "flag")
_on_comments("is_single_word", lambda: G.is_single_word(T.clean_text(raw())), Q.is_single_word(Q.clean("comment_text")), "flag")
_on_comments("has_many_urls", lambda: G.has_many_urls(raw()), f"{Q.url_count('comment_text')} >= 2", "flag")
_on_comments("is_link_only", lambda: G.is_link_only(raw()), Q.link_only("comment_text"), "flag")
_on_comments("has_promo_text", lambda: G.has_promo_text(raw()), Q.promo("comment_text"), "flag")
_on_comments("is_solicitation", lambda: G.is_solicitation(raw()), Q.solicitation("comment_text"), "flag")
_on_comments("is_emoji_only", lambda: G.is_emoji_only(raw()), Q.emoji_only("comment_text"), "flag")
_on_comments("has_repeated_chars", lambda: G.has_repeated_chars(raw()), Q.repeated("comment_text"), "flag")
_on_comments("is_spam", lambda: G.is_spam(raw()), Q.is_spam("comment_text"), "flag")
register(
    "preprocess_filter", lambda t: C.preprocess_comments(t.comments).select("comment_id", S.CLEANED),
    Q.with_flagged("SELECT comment_id, cleaned_comment_text FROM flagged WHERE NOT is_removed_by_cleaning"),
)
register(
    "final_cleanup",
    lambda t: t.comments.select("comment_id", raw()).filter(~G.fails_final_cleanup(raw())),
    Q.with_comments(f"""SELECT comment_id, comment_text FROM comments WHERE NOT coalesce({Q.strip('comment_text')} = ''
      OR length({Q.strip('comment_text')}) < 3 OR starts_with({Q.strip('comment_text')}, 'http')
      OR {Q.is_single_word('comment_text')} OR {Q.emoji_only('comment_text')}, true)"""),
)
register(
    "eda_filter", lambda t: C.analysis_rows(C.flag_comments(t.comments)).select("comment_id", "product_query"),
    Q.with_flagged("SELECT comment_id, product_query FROM flagged WHERE NOT is_spam AND NOT is_empty"),
)
register(
    "product_filter", lambda t: t.comments.filter(F.col("product_query") == "Steam Deck").select("comment_id", "comment_text"),
    Q.with_comments("SELECT comment_id, comment_text FROM comments WHERE product_query = 'Steam Deck'"),
)
register(
    "browse_filter",
    lambda t: C.browse(
        t.comments.withColumnRenamed("like_count", "comment_like_count").withColumn(S.CLEANED, raw()), 25
    ).select("comment_id", "comment_like_count"),
    Q.with_comments("SELECT comment_id, like_count AS comment_like_count FROM comments WHERE like_count >= 25 AND comment_text IS NOT NULL"),
)
register(
    "labelled_rows", lambda t: t.annotated.filter(B.is_filled(F.col("aspect_label")) & raw().isNotNull()).select("comment_id", "aspect_label"),
    Q.with_annotated("SELECT comment_id, aspect_label FROM annotated WHERE trim(aspect_label) <> '' AND comment_text IS NOT NULL"),
)

# Pseudo-labels: events with their type as label and a confidence derived from the id.
PSEUDO_SQL = """pseudo AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'Other' ELSE event_type END AS pseudo_aspect,
  (event_id * 7919 % 1000) / 1000.0::DOUBLE AS confidence FROM events)"""


def pseudo(t):
    label = F.when(F.col("event_type") == "error", "Other").otherwise(F.col("event_type"))
    return t.events.select(
        "event_id", label.alias("pseudo_aspect"), (F.col("event_id") * 7919 % 1000 / F.lit(1000.0)).alias("confidence")
    )


register("high_confidence", lambda t: learning.high_confidence(pseudo(t)),
         f"WITH {PSEUDO_SQL} SELECT * FROM pseudo WHERE confidence >= 0.90::DOUBLE")
register("non_other_confident", lambda t: learning.non_other_confident(pseudo(t)),
         f"WITH {PSEUDO_SQL} SELECT * FROM pseudo WHERE pseudo_aspect <> 'Other' AND confidence >= 0.95::DOUBLE")
register("per_class_threshold", lambda t: learning.accept_confident(pseudo(t)),
         f"WITH {PSEUDO_SQL} SELECT * FROM pseudo WHERE confidence >= CASE WHEN pseudo_aspect = 'Other' THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END")
register(
    "invalid_url",
    lambda t: t.pages.select("page_id", F.when(F.col("page_id") % 9 == 4, F.concat(F.lit("ftp:"), "url")).otherwise(F.col("url")).alias("url"))
    .filter(G.is_invalid_url(F.col("url"))),
    """SELECT * FROM (SELECT page_id, CASE WHEN page_id % 9 = 4 THEN 'ftp:' || url ELSE url END AS url FROM pages)
       WHERE NOT regexp_matches(trim(url), '(?i)^https?://')""",
)


def _dates():
    return F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("bad-"), "o_orderpriority")).when(
    F.col("o_orderkey") % 7 == 0, F.lit(None)).when(F.col("o_orderkey") % 11 == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).when(
        F.col("o_orderkey") % 13 == 1, F.date_format("o_orderdate", "yyyyMMdd")).when(
        F.col("o_orderkey") % 17 == 1, F.date_format("o_orderdate", "MMM d, yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


register(
    "invalid_timestamp",
    lambda t: t.orders.select("o_orderkey", _dates().alias("published_at")).filter(G.is_invalid_timestamp(F.col("published_at"))),
    """SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'bad-' || o_orderpriority WHEN o_orderkey % 7 = 0 THEN NULL
         WHEN o_orderkey % 11 = 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN o_orderkey % 13 = 1 THEN strftime(o_orderdate, '%Y%m%d')
         WHEN o_orderkey % 17 = 1 THEN strftime(o_orderdate, '%b %-d, %Y') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS published_at FROM orders)
       WHERE published_at IS NOT NULL AND try_cast(published_at AS TIMESTAMPTZ) IS NULL
         AND try_strptime(published_at, ['%Y/%m/%d', '%Y%m%d', '%b %d, %Y']) IS NULL""",
)

# --- languages ----------------------------------------------------------------
_on_comments("detect_language", lambda: L.detect_language(raw()), Q.detect_language("comment_text"), "label")
register(
    "indic_script_counts",
    lambda t: t.comments.select("comment_id", F.explode(L.indic_script_counts(raw())).alias("script", "n")),
    Q.with_comments(f"SELECT comment_id, s.n AS script, -s.r AS n FROM (SELECT comment_id, unnest({Q.script_hits('comment_text')}) AS s FROM comments)"),
)
register(
    "mixed_label",
    lambda t: t.comments.select("comment_id", L.detect_language(F.concat(raw(), F.lit(" আই ఈ ఈ"))).alias("label"))
    .filter(F.col("label").startswith("mixed_")),
    Q.with_comments(f"SELECT * FROM (SELECT comment_id, {Q.detect_language('(comment_text || ' + lit(' আই ఈ ఈ') + ')')} AS label FROM comments) WHERE label LIKE 'mixed\\_%' ESCAPE '\\'"),
)
register(
    "romanized_markers",
    lambda t: t.comments.select("comment_id", L.has_hinglish_marker(raw()).alias("hinglish"), L.has_malayalam_marker(raw()).alias("malayalam")),
    Q.with_comments(f"SELECT comment_id, {Q.marker('comment_text', X.HINGLISH_MARKERS)} AS hinglish, {Q.marker('comment_text', X.MALAYALAM_ROMAN_MARKERS)} AS malayalam FROM comments"),
)
_SCRIPTS_SQL = {
    "rus_Cyrl": r"\p{Cyrillic}", "ara_Arab": r"\p{Arabic}", "hin_Deva": r"\p{Devanagari}", "mal_Mlym": r"\p{Malayalam}",
    "tam_Taml": r"\p{Tamil}", "kan_Knda": r"\p{Kannada}", "guj_Gujr": r"\p{Gujarati}",
}
_HEAD = "left(" + Q.rep("remark", f"[{Q._WS}]+", "") + ", 200)"


def _headed():
    """The remark's script first."""
    return F.concat(F.substring_index(raw(), " ", -4), raw())


register(
    "detect_script_code", lambda t: t.comments.select("comment_id", L.detect_script_code(_headed()).alias("code")),
    Q.with_comments(f"""SELECT comment_id, (list_sort([{{'r': -len(regexp_extract_all(head, p.v)), 'c': p.k}} FOR p IN
        [{', '.join(f"{{'k': {lit(k)}, 'v': {lit(v)}}}" for k, v in _SCRIPTS_SQL.items())}]
        IF len(regexp_extract_all(head, p.v)) >= greatest(2, length(head) * 0.2)]))[1].c AS code
      FROM (SELECT comment_id, coalesce({_HEAD.replace('remark', "(array_to_string(string_split(comment_text, ' ')[-4:], ' ') || comment_text)")}, '') AS head FROM comments)"""),
)
register(
    "language_code_lookup",
    lambda t: t.comments.select("comment_id", L.language_code(L.detect_language(raw())).alias("code")),
    Q.with_comments(f"SELECT comment_id, {Q.lookup('label', X.LANGUAGE_CODES)} AS code FROM (SELECT comment_id, {Q.detect_language('comment_text')} AS label FROM comments)"),
)

# A user-supplied dictionary: short words of the test languages and the remarks.
DICTIONARY = {
    "bhai": "brother", "hai": "is", "bahut": "very", "accha": "good", "accha hai": "is good", "der die": "the the",
    "und": "and", "der": "the", "die": "the", "von": "from", "le": "the", "la": "the", "que": "that", "el": "he",
}


def _normalized_sql(x: str) -> str:
    y = f"lower({x})"
    for phrase in sorted((k for k in DICTIONARY if " " in k), key=len, reverse=True):
        # Runs keep their separators: a phrase is replaced between word boundaries.
        y = Q.rep(y, rf"(^|{Q.NOT_WORD}){phrase}($|{Q.NOT_WORD})", rf"\1{DICTIONARY[phrase]}\2")
        y = Q.rep(y, rf"(^|{Q.NOT_WORD}){phrase}($|{Q.NOT_WORD})", rf"\1{DICTIONARY[phrase]}\2")
    words = {k: v for k, v in DICTIONARY.items() if " " not in k}
    each = f"CASE r {' '.join(f'WHEN {lit(k)} THEN {lit(v)}' for k, v in words.items())} ELSE r END"
    return f"array_to_string([{each} FOR r IN regexp_extract_all({y}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')], '')"


_on_comments("normalize_hinglish", lambda: R.normalize_romanized(raw(), DICTIONARY),
             f"CASE WHEN {Q.strip('comment_text')} = '' THEN comment_text ELSE {_normalized_sql('comment_text')} END", "english")
_on_comments(
    "hinglish_dominated", lambda: R.is_dictionary_dominated(raw(), DICTIONARY),
    f"""coalesce((SELECT count(*) FILTER (w IN ({', '.join(lit(k) for k in DICTIONARY)})) / nullif(count(*), 0)::DOUBLE >= 0.15::DOUBLE
       FROM (SELECT unnest(regexp_extract_all(lower(comment_text), {lit(f'[^{Q._WS}]+')})) AS w)), false)""", "dominated")

# --- similarity ---------------------------------------------------------------


def _jaccard_sql(a: str, b: str, source: str, key: str) -> str:
    return f"""WITH {source}, n AS (SELECT {key}, lower({Q.whitespace(a)}) AS a, lower({Q.whitespace(b)}) AS b FROM comments),
      g AS (SELECT {key}, a, b, list_distinct([x[i] || x[i+1] FOR i IN range(1, len(x))]) AS ga, list_distinct([y[i] || y[i+1] FOR i IN range(1, len(y))]) AS gb
        FROM (SELECT *, string_split(a, '') AS x, string_split(b, '') AS y FROM n)),
      s AS (SELECT *, len(list_intersect(ga, gb)) AS common FROM g)
      SELECT {key}, CASE WHEN a = '' AND b = '' THEN 1.0 WHEN a = '' OR b = '' THEN 0.0
        WHEN len(ga) + len(gb) - common = 0 THEN 1.0 ELSE common::DOUBLE / (len(ga) + len(gb) - common)::DOUBLE END AS similarity FROM s
      WHERE a IS NOT NULL AND b IS NOT NULL"""


register(
    "bigram_jaccard",
    lambda t: t.comments.filter(raw().isNotNull()).select("comment_id", T.bigram_jaccard(raw(), F.col("text")).alias("similarity")),
    _jaccard_sql("comment_text", "text", Q.COMMENTS_SQL, "comment_id"),
)
register(
    "text_similarity",
    lambda t: t.comments.filter(raw().isNotNull()).select("comment_id", (T.bigram_jaccard(raw(), F.reverse("text")) > 0.85).alias("untranslated")),
    "SELECT comment_id, similarity > 0.85::DOUBLE AS untranslated FROM (" + _jaccard_sql("comment_text", "reverse(text)", Q.COMMENTS_SQL, "comment_id") + ")",
)
register(
    "token_set_intersect",
    lambda t: t.comments.select("comment_id", F.array_join(T.token_set_intersect(raw(), X.HINGLISH_MARKERS), ",").alias("markers")),
    Q.with_comments(f"""SELECT comment_id, array_to_string(list_sort(list_intersect(list_distinct(regexp_extract_all(lower(comment_text), '[a-z]+')),
        [{Q.lits(X.HINGLISH_MARKERS)}])), ',') AS markers FROM comments"""),
)

# --- labels and numbers -------------------------------------------------------
register("product_slug", lambda t: t.comments.select("comment_id", T.product_slug(F.concat(F.col("product_query"), F.lit("! "))).alias("slug")),
         Q.with_comments(f"SELECT comment_id, {Q.slug('(product_query || ' + lit('! ') + ')')} AS slug FROM comments"))
register("safe_int", lambda t: t.orders.select("o_orderkey", B.safe_long(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.format_string(" %d ", "o_custkey"))).alias("value")),
         "SELECT o_orderkey, try_cast(trim(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE ' ' || o_custkey || ' ' END) AS BIGINT) AS value FROM orders")
register("coerce_numeric", lambda t: t.orders.select("o_orderkey", B.coerce_numeric(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 7 == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit("d"))).otherwise(F.col("o_totalprice").cast("string"))).alias("value")),
         "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN try_cast(o_orderpriority AS DOUBLE) WHEN o_orderkey % 7 = 0 THEN try_cast(o_orderkey || 'd' AS DOUBLE) ELSE o_totalprice END AS value FROM orders")
register("normalize_label", lambda t: t.annotated.select("comment_id", B.normalize_sentiment_label(F.col("sentiment_label")).alias("label")),
         Q.with_annotated(f"SELECT comment_id, CASE WHEN sentiment_label IS NULL OR trim(sentiment_label) = '' THEN 'Neutral' ELSE {Q.title('trim(sentiment_label)')} END AS label FROM annotated"))
register("normalize_aspect", lambda t: t.annotated.select("comment_id", B.normalize_aspect(F.col("aspect_label")).alias("label")),
         Q.with_annotated("SELECT comment_id, coalesce(trim(aspect_label), 'Other') AS label FROM annotated"))
register("label_key", lambda t: t.annotated.select("comment_id", B.label_key(F.col("aspect_label")).alias("label_key")),
         Q.with_annotated("SELECT comment_id, replace(lower(aspect_label), ' ', '_') AS label_key FROM annotated"))
register("title_case_label", lambda t: t.annotated.select("comment_id", T.title_case(T.strip(F.col("review_notes"))).alias("note")),
         Q.with_annotated(f"SELECT comment_id, {Q.title('trim(review_notes)')} AS note FROM annotated"))
register(
    "lowercase_keys",
    lambda t: t.annotated.select("comment_id", F.explode(B.lowercase_keys(F.create_map(T.strip(F.coalesce("sentiment_label", F.lit("None"))), F.col("like_count")))).alias("sentiment", "n")),
    Q.with_annotated("SELECT comment_id, lower(trim(coalesce(sentiment_label, 'None'))) AS sentiment, like_count AS n FROM annotated"),
)
register("like_weight", lambda t: t.comments.select("comment_id", F.round(B.like_weight(F.col("n_chars")), 9).alias("weight")),
         Q.with_comments("SELECT comment_id, round(least(1 + log2(1 + n_chars), 10), 9) AS weight FROM comments"))
register("video_url", lambda t: t.comments.select("comment_id", T.watch_url(F.col("video_id")).alias("video_url")),
         Q.with_comments(f"SELECT comment_id, {lit(X.WATCH_URL)} || video_id AS video_url FROM comments"))
register("project_preview", lambda t: t.comments.select("comment_id", *[T.preview(raw(), n).alias(f"text_{n}") for n in (80, 120, 150, 200)]),
         Q.with_comments("SELECT comment_id, " + ", ".join(f"left(comment_text, {n}) AS text_{n}" for n in (80, 120, 150, 200)) + " FROM comments"))

# --- keyword predicates -------------------------------------------------------
_FEATURE_ANY = X.FEATURE_KEYWORDS["Display"] + X.FEATURE_KEYWORDS["Price"]
register("keyword_any_filter", lambda t: terms.keyword_any_filter(t.comments, _FEATURE_ANY, "comment_text").select("comment_id"),
         Q.with_comments(f"SELECT comment_id FROM comments WHERE {Q.contains_any('lower(comment_text)', _FEATURE_ANY)}"))


def word_hit(x: str, word: str) -> str:
    return f"regexp_matches(coalesce({x}, ''), {lit(f'(?i)(^|{Q.NOT_WORD}){word}($|{Q.NOT_WORD})')})"


register("negation_counts", lambda t: terms.keyword_rows(t.comments, X.NEGATION_KEYWORDS, "comment_text"),
         Q.with_comments(" UNION ALL ".join(f"SELECT {lit(w)} AS keyword, count(*) FILTER ({word_hit('comment_text', w)}) AS n FROM comments" for w in X.NEGATION_KEYWORDS)))
register("keyword_word_count", lambda t: terms.feature_word_counts(t.comments, X.FEATURE_KEYWORDS, "comment_text", ["product_query"]),
         Q.with_comments(" UNION ALL ".join(
             f"SELECT product_query, {lit(f)} AS feature, " + " + ".join(f"count(*) FILTER ({word_hit('comment_text', w)})" for w in ws) + " AS n FROM comments GROUP BY 1"
             for f, ws in X.FEATURE_KEYWORDS.items())))
register("lexicon_any_counts", lambda t: terms.feature_sentiment_counts(t.comments, X.FEATURE_KEYWORDS, X.FEATURE_POSITIVE, X.FEATURE_NEGATIVE, "comment_text"),
         Q.with_comments("SELECT * FROM (" + " UNION ALL ".join(
             f"SELECT {lit(f)} AS feature, count(*) FILTER ({Q.contains_any('lower(comment_text)', X.FEATURE_POSITIVE)}) AS positive, "
             f"count(*) FILTER ({Q.contains_any('lower(comment_text)', X.FEATURE_NEGATIVE)}) AS negative FROM comments WHERE {Q.contains_any('lower(comment_text)', ws)}"
             for f, ws in X.FEATURE_KEYWORDS.items()) + ")"))
