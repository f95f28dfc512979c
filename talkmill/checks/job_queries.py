"""Sentiment, competitors, terms, translation, learning, streaming and composite jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill import schemas as S
from talkmill.checks import sql as Q
from talkmill.checks.bindings import PER_VIDEO, comments_of, lit
from talkmill.checks.registry import register
from talkmill.checks.text_queries import DICTIONARY, _normalized_sql
from talkmill.functions import lexicons as X, sentiment as SE
from talkmill.functions.competitors import extract_competitors
from talkmill.operators import cleaning as C, insights as I, language_audit as L
from talkmill.operators import terms as TE, translation as TR
from talkmill.plans import jobs
from talkmill.session import run_dir
from talkmill.streaming import jobs as stream


def raw():
    return F.col("comment_text")


def _scored(t):
    return I.add_rule_sentiment(t.comments, "comment_text")


# --- sentiment ------------------------------------------------------------------
register("rule_sentiment", lambda t: t.comments.select("comment_id", SE.sentiment_score(raw()).alias("score"), SE.rule_sentiment(raw()).alias("label")),
         Q.with_scored("SELECT comment_id, score, predicted_sentiment AS label FROM scored"))
_STOP = ["the", "of", "and", "is", "to", "in", "le", "la", "de", "der", "die", "und", "el", "que"]


def _valence(t):
    """A valence table from the corpus itself: terms weighted by how their rows are labelled."""
    words = TE.term_counts(t.documents, "text", 1, _STOP)
    return words.select(F.col("term").alias("token"), (F.col("n") % 7 - 3).alias("valence"))


_VALENCE_SQL = f"""valence AS (SELECT term AS token, n % 7 - 3 AS v FROM (SELECT term, count(*) AS n FROM (SELECT unnest({Q.terms('text', _STOP)}) AS term FROM documents) GROUP BY 1)),
  hit AS (SELECT comment_id, sum(v)::DOUBLE AS s FROM (SELECT comment_id, unnest({Q.terms('comment_text')}) AS token FROM comments) JOIN valence USING (token) GROUP BY 1),
  comp AS (SELECT comment_id, coalesce(s, 0::DOUBLE) AS valence_sum, coalesce(s, 0::DOUBLE) / sqrt(coalesce(s, 0::DOUBLE) * coalesce(s, 0::DOUBLE) + 15.0::DOUBLE) AS compound FROM comments LEFT JOIN hit USING (comment_id))"""
register("lexicon_compound", lambda t: I.lexicon_compound(t.comments, _valence(t), "comment_id", "comment_text"), Q.with_comments(
    "SELECT *, CASE WHEN compound >= 0.05::DOUBLE THEN 'Positive' WHEN compound <= -0.05::DOUBLE THEN 'Negative' ELSE 'Neutral' END AS label FROM comp", _VALENCE_SQL))
register("sentiment_distribution", lambda t: I.sentiment_distribution(_scored(t), digits=None), Q.with_scored(
    "SELECT product_query, predicted_sentiment, n, n / (sum(n) OVER (PARTITION BY product_query))::DOUBLE * 100 AS pct FROM (SELECT product_query, predicted_sentiment, count(*) AS n FROM scored GROUP BY 1, 2)"))
register("share_of_group", lambda t: I.sentiment_distribution(t.documents, "source", "lang", None),
         "SELECT source, lang, n, n / (sum(n) OVER (PARTITION BY source))::DOUBLE * 100 AS pct FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)")
# Flagship: clean, flag, filter, score, aggregate.
register("product_sentiment", lambda t: I.sentiment_distribution(I.add_rule_sentiment(C.preprocess_comments(t.comments)), digits=None), Q.with_flagged(
    "SELECT product_query, predicted_sentiment, n, n / (sum(n) OVER (PARTITION BY product_query))::DOUBLE * 100 AS pct FROM (SELECT product_query, predicted_sentiment, count(*) AS n FROM kept GROUP BY 1, 2)",
    f"ktoks AS (SELECT *, {Q.sentiment_tokens('cleaned_comment_text')} AS tk FROM flagged WHERE NOT is_removed_by_cleaning)",
    f"kpoints AS (SELECT *, {Q.sentiment_score('tk')} AS score FROM ktoks)",
    f"kept AS (SELECT product_query, {Q.sentiment_label('score')} AS predicted_sentiment FROM kpoints)"))

# --- competitors ------------------------------------------------------------------
_COMPETITORS = f"named AS (SELECT product_query, unnest({Q.competitors('comment_text', 'product_query')}) AS competitor, comment_id FROM comments)"
_MENTIONS = "mentioned AS (SELECT *, row_number() OVER (PARTITION BY product_query ORDER BY mentions DESC, competitor) AS r FROM (SELECT product_query, competitor, count(*) AS mentions FROM named GROUP BY 1, 2))"
register("extract_competitors", lambda t: t.comments.select("comment_id", F.explode(extract_competitors(raw(), F.col("product_query"))).alias("competitor")),
         Q.with_comments("SELECT comment_id, competitor FROM named", _COMPETITORS))
register("competitor_mentions", lambda t: I.competitor_mentions(t.comments, text="comment_text", n=None),
         Q.with_comments("SELECT product_query, competitor, mentions FROM mentioned", _COMPETITORS, _MENTIONS))
register("topk_competitors", lambda t: I.competitor_mentions(t.comments, text="comment_text", n=3),
         Q.with_comments("SELECT product_query, competitor, mentions FROM mentioned WHERE r <= 3", _COMPETITORS, _MENTIONS))
register("sample_comments_per_sentiment", lambda t: I.sample_comments(_scored(t), "comment_id", text="comment_text"), Q.with_scored(
    """SELECT product_query, predicted_sentiment, comment_id, comment_text, r AS example_rank FROM (SELECT *, row_number() OVER (PARTITION BY product_query, predicted_sentiment ORDER BY comment_id) AS r
       FROM scored WHERE comment_text IS NOT NULL) WHERE r <= 5"""))

register("sample_comments_two_pass", lambda t: I.sample_comments(
    jobs.staged(_scored(t), run_dir(t.spark, "scored"), "scored"), "comment_id", text="comment_text", two_pass=True), Q.with_scored(
    """SELECT product_query, predicted_sentiment, comment_id, comment_text, r AS example_rank FROM (SELECT *, row_number() OVER (PARTITION BY product_query, predicted_sentiment ORDER BY comment_id) AS r
       FROM scored WHERE comment_text IS NOT NULL) WHERE r <= 5"""))


register("insight_summary", lambda t: I.insight_summary(t.comments, text="comment_text").select("product_query", "total_comments", "positive", "negative", "competitor", "mentions"), Q.with_scored(
    """SELECT product_query, count(*) AS total_comments, count(*) FILTER (predicted_sentiment = 'Positive') AS positive, count(*) FILTER (predicted_sentiment = 'Negative') AS negative,
       max(m.competitor) AS competitor, max(m.mentions) AS mentions FROM scored LEFT JOIN (SELECT product_query, competitor, mentions FROM mentioned WHERE r = 1) m USING (product_query) GROUP BY 1""", _COMPETITORS, _MENTIONS))


# --- terms ----------------------------------------------------------------------
def _grams(tokens: str, n: int) -> str:
    return f"[array_to_string({tokens}[i:i+{n - 1}], ' ') FOR i IN range(1, len({tokens}) - {n - 2})]" if n > 1 else tokens


def _top_sql(n: int, size: int, stop: list[str], limit: str = "") -> str:
    return f"""SELECT term, count(*) AS n FROM (SELECT unnest({_grams('tk', size)}) AS term FROM (SELECT {Q.terms('text', stop)} AS tk FROM documents)) GROUP BY 1
      ORDER BY 2 DESC, 1 LIMIT {n}"""


register("top_terms", lambda t: TE.top_terms(t.documents, 50, "text", 1, _STOP), _top_sql(50, 1, _STOP))
register("top_bigrams", lambda t: TE.top_terms(t.documents, 50, "text", 2, _STOP), _top_sql(50, 2, _STOP))
register("top_ngrams", lambda t: TE.top_terms(t.documents, 50, "text", 3, _STOP), _top_sql(50, 3, _STOP))
_DROP = ["on", "en", "an", "er"]
register("custom_stopwords", lambda t: TE.top_terms(t.documents, 100, "text", 1, _STOP, _DROP),
         f"SELECT * FROM ({_top_sql(100, 1, _STOP)}) WHERE term NOT IN ({Q.lits(_DROP)})")
register("per_product_terms", lambda t: TE.top_terms_by(t.documents, "source", 30, "text", 2, _STOP),
         f"""SELECT source, term, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS r FROM (SELECT source, term, count(*) AS n FROM
             (SELECT source, unnest({_grams('tk', 2)}) AS term FROM (SELECT source, {Q.terms('text', _STOP)} AS tk FROM documents)) GROUP BY 1, 2)) WHERE r <= 30""")


def _phrases(t):
    done = TE.topic_phrases(t.documents.withColumn("id", F.format_string("%08d", "doc_id")), "lang", "id", 10, "text", _STOP)
    return done.select("lang", "phrase", "tf", "df", "score", F.size("examples").alias("shown"), F.md5(F.array_join("examples", "|")).alias("texts"))


register("topic_phrases", _phrases, f"""WITH tk AS (SELECT doc_id, lang, text, {Q.terms('text', _STOP)} AS u FROM documents),
  ph AS (SELECT doc_id, lang, text, unnest(list_concat(u, {_grams('u', 2)})) AS phrase FROM tk),
  c AS (SELECT lang, phrase, count(*) AS tf, count(DISTINCT doc_id) AS df FROM ph GROUP BY 1, 2), n AS (SELECT lang, count(*) AS rows FROM documents GROUP BY 1),
  s AS (SELECT *, round(tf * ln(rows / df::DOUBLE), 6) AS score FROM c JOIN n USING (lang)),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, phrase) AS r FROM s) WHERE r <= 10),
  ex AS (SELECT DISTINCT lang, phrase, doc_id, text FROM ph SEMI JOIN top USING (lang, phrase)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY doc_id) AS k FROM ex)
  SELECT lang, phrase, tf, df, score, (SELECT count(*) FROM rk WHERE rk.lang = top.lang AND rk.phrase = top.phrase AND k <= 3) AS shown,
    (SELECT md5(string_agg(text, '|' ORDER BY k)) FROM rk WHERE rk.lang = top.lang AND rk.phrase = top.phrase AND k <= 3) AS texts FROM top""")

# --- aspects ----------------------------------------------------------------------
_ASPECT = "aspect_label"


def _aspects(t):
    return I.add_rule_sentiment(t.annotated.filter("trim(aspect_label) <> ''"), "comment_text")


_ASPECTS_SQL = [Q.ANNOTATED_SQL, f"atok AS (SELECT *, {Q.sentiment_tokens('comment_text')} AS tk FROM annotated WHERE trim(aspect_label) <> '')",
                f"asc1 AS (SELECT *, {Q.sentiment_score('tk')} AS score FROM atok)", f"asp AS (SELECT *, {Q.sentiment_label('score')} AS predicted_sentiment FROM asc1)"]
register("aspect_distribution", lambda t: I.aspect_distribution(_aspects(t), _ASPECT), Q.with_comments(
    """SELECT product_query, aspect_label, mentions, pct FROM (SELECT *, mentions / (sum(mentions) OVER (PARTITION BY product_query))::DOUBLE * 100 AS pct,
       row_number() OVER (PARTITION BY product_query ORDER BY mentions DESC, aspect_label) AS r FROM (SELECT product_query, aspect_label, count(*) AS mentions FROM asp GROUP BY 1, 2)) WHERE r <= 8 AND aspect_label <> 'Spam'""", *_ASPECTS_SQL))
register("aspect_sentiment_matrix", lambda t: I.aspect_sentiment_matrix(_aspects(t), _ASPECT), Q.with_comments(
    "SELECT aspect_label, " + ", ".join(f"count(*) FILTER (predicted_sentiment = {lit(s)}) AS {s.lower()}" for s in X.SENTIMENT_LABELS) + " FROM asp GROUP BY 1", *_ASPECTS_SQL))
register("top_pos_neg_aspects", lambda t: I.top_aspects(_aspects(t), _ASPECT, "Positive"), Q.with_comments(
    """SELECT product_query, aspect_label, mentions, hits, pct FROM (SELECT *, row_number() OVER (PARTITION BY product_query ORDER BY pct DESC, aspect_label) AS r FROM
       (SELECT *, hits / mentions::DOUBLE * 100 AS pct FROM (SELECT product_query, aspect_label, count(*) AS mentions, count(*) FILTER (predicted_sentiment = 'Positive') AS hits FROM asp GROUP BY 1, 2))) WHERE r <= 5""", *_ASPECTS_SQL))
register("top_comments_by_aspect", lambda t: I.top_comments_by_aspect(_aspects(t), _ASPECT, "comment_id", text="comment_text"), Q.with_comments(
    """SELECT product_query, aspect_label, predicted_sentiment, comment_id, left(comment_text, 150) AS comment_text, r AS example_rank FROM
       (SELECT *, row_number() OVER (PARTITION BY product_query, aspect_label, predicted_sentiment ORDER BY comment_id) AS r FROM asp WHERE predicted_sentiment <> 'Neutral') WHERE r <= 2""", *_ASPECTS_SQL))

# --- translation ------------------------------------------------------------------
# Landed translations: other text, the same text, or blank.


def _landed():
    return F.when(F.col("doc_id") % 3 == 0, F.concat_ws(" ", F.md5(raw()), F.sha1(raw()))).when(F.col("doc_id") % 3 == 1, raw()).when(F.col("doc_id") % 6 == 2, F.lit(" "))


_LANDED_SQL = "CASE WHEN doc_id % 3 = 0 THEN concat_ws(' ', md5(comment_text), sha1(comment_text)) WHEN doc_id % 3 = 1 THEN comment_text WHEN doc_id % 6 = 2 THEN ' ' END"


def _audited(t):
    audited = L.add_detected_language(t.comments.select("doc_id", "comment_id", "comment_text"))
    return jobs.staged(audited, run_dir(t.spark, "audit"), "language_audited")


_DETECTED = f"det AS (SELECT doc_id, comment_id, comment_text, {Q.detect_language('comment_text')} AS detected_language FROM comments)"
_CODED = f"""coded AS (SELECT d.*, coalesce({Q.lookup('detected_language', X.LANGUAGE_CODES)}, f.code) AS source_code FROM det d LEFT JOIN (SELECT detected_language AS dl, arg_min(code, comment_id) AS code
  FROM (SELECT *, {{code}} AS code FROM det WHERE coalesce(comment_text, '') <> '' AND {Q.lookup('detected_language', X.LANGUAGE_CODES)} IS NULL) GROUP BY 1) f ON f.dl = d.detected_language WHERE detected_language <> 'english')"""
register("route_non_english", lambda t: TR.route_non_english(_audited(t)).select("comment_id", "detected_language"),
         Q.with_comments("SELECT comment_id, detected_language FROM det WHERE detected_language <> 'english'", _DETECTED))


def _script_sql(x: str) -> str:
    """Dominant script of the first 200 non-space characters."""
    codes = [("rus_Cyrl", "Cyrillic"), ("ara_Arab", "Arabic"), ("hin_Deva", "Devanagari"), ("mal_Mlym", "Malayalam"), ("tam_Taml", "Tamil"), ("kan_Knda", "Kannada"), ("guj_Gujr", "Gujarati")]
    head = "left(" + Q.rep(x, f"[{Q._WS}]+", "") + ", 200)"
    return f"""(list_sort([{{'r': -len(regexp_extract_all({head}, p.v)), 'c': p.k}} FOR p IN [{', '.join(f"{{'k': {lit(k)}, 'v': {lit(chr(92) + 'p{' + v + '}')}}}" for k, v in codes)}]
        IF len(regexp_extract_all({head}, p.v)) >= greatest(2, length({head}) * 0.2)]))[1].c"""


_WITH_CODES = _CODED.format(code=_script_sql("comment_text"))
register("resolve_source_code", lambda t: TR.resolve_source_code(TR.route_non_english(_audited(t)), "comment_id").select("comment_id", "detected_language", "source_code"),
         Q.with_comments("SELECT comment_id, detected_language, source_code FROM coded", _DETECTED, _WITH_CODES))
register("apply_translations", lambda t: TR.apply_translations(
    TR.route_non_english(_audited(t)), t.comments.select("comment_id", _landed().alias("translation")), ["comment_id"]).select("comment_id", "translation"),
    Q.with_comments(f"SELECT comment_id, {_LANDED_SQL} AS translation FROM det WHERE detected_language <> 'english'", _DETECTED))


def _echo_translator():
    def echo(texts, code):
        if code == "hin_Deva":
            raise RuntimeError("translator down")
        return [f"{code} {x}" for x in texts]

    return echo


register("translate_with_function",
         lambda t: TR.translate_with(TR.resolve_source_code(TR.route_non_english(_audited(t)), "comment_id"), _echo_translator()).select("comment_id", "translation"),
         Q.with_comments("SELECT comment_id, CASE WHEN source_code IS NULL THEN NULL WHEN source_code = 'hin_Deva' THEN coalesce(comment_text, '') ELSE source_code || ' ' || coalesce(comment_text, '') END AS translation FROM coded", _DETECTED, _WITH_CODES))


def _translated(t):
    landed = t.comments.select("comment_id", _landed().alias("translation"))
    base = _audited(t).withColumn(S.CLEANED, raw())
    return TR.translate_comments(base, lambda d: TR.apply_translations(d, landed, ["comment_id"]), DICTIONARY, "comment_id")


_GATED = [_DETECTED, _WITH_CODES, f"land AS (SELECT *, {Q.strip(_LANDED_SQL)} AS result FROM coded)",
    f"""nrm AS (SELECT *, lower({Q.whitespace("coalesce(comment_text, '')")}) AS a, lower({Q.whitespace("coalesce(result, '')")}) AS b FROM land)""",
    """gram AS (SELECT * EXCLUDE (x, y), list_distinct([x[i] || x[i+1] FOR i IN range(1, len(x))]) AS ga, list_distinct([y[i] || y[i+1] FOR i IN range(1, len(y))]) AS gb FROM (SELECT *, string_split(a, '') AS x, string_split(b, '') AS y FROM nrm))""",
    """sims AS (SELECT *, CASE WHEN a = '' AND b = '' THEN 1.0 WHEN a = '' OR b = '' THEN 0.0 WHEN len(ga) + len(gb) = 0 THEN 1.0 ELSE len(list_intersect(ga, gb))::DOUBLE / (len(ga) + len(gb) - len(list_intersect(ga, gb)))::DOUBLE END AS sim FROM gram)""",
    f"""gate AS (SELECT *, CASE WHEN source_code IS NULL OR coalesce(result, '') = '' THEN NULL WHEN sim > 0.85::DOUBLE AND detected_language IN ('hinglish', 'romanized_malayalam') THEN {_normalized_sql('comment_text')}
        WHEN sim > 0.85::DOUBLE THEN NULL ELSE result END AS accepted FROM sims)""",
    f"""fin AS (SELECT comment_id, detected_language, {Q.clean('accepted')} AS cleaned_comment_text, accepted IS NOT NULL AS is_translated, {Q.clean('accepted')} = '' AS is_removed_by_translation FROM gate
        UNION ALL SELECT comment_id, detected_language, comment_text, false, false FROM det WHERE detected_language = 'english')""",
    f"""tidy AS (SELECT *, coalesce({Q.strip('cleaned_comment_text')} = '' OR length({Q.strip('cleaned_comment_text')}) < 3 OR starts_with({Q.strip('cleaned_comment_text')}, 'http')
        OR {Q.is_single_word('cleaned_comment_text')} OR {Q.emoji_only('cleaned_comment_text')}, true) AS is_removed_in_final_cleanup FROM fin)"""]
register("gate_and_fallback", lambda t: _translated(t).select("comment_id", S.CLEANED, S.IS_TRANSLATED, S.REMOVED_BY_TRANSLATION),
         Q.with_comments("SELECT comment_id, cleaned_comment_text, is_translated, is_removed_by_translation FROM fin", *_GATED))
register("translation_flags", lambda t: TR.with_flags(t.documents.select("doc_id")), "SELECT doc_id, false AS is_translated, false AS is_removed_by_translation FROM documents")
register("translation_report", lambda t: TR.translation_report(_translated(t)), Q.with_comments(
    "SELECT count(*) AS total_comments, count(*) FILTER (is_translated) AS translated_comments, count(*) FILTER (is_removed_by_translation) AS removed_by_translation_failure FROM fin", *_GATED))
register("translated_by_language", lambda t: TR.translated_by_language(_translated(t)), Q.with_comments(
    "SELECT detected_language, count(*) AS n FROM fin WHERE is_translated GROUP BY 1", *_GATED))
register("readiness_report", lambda t: TR.readiness_report(_translated(t)), Q.with_comments(
    f"""SELECT count(*) AS rows_before_cleanup, count(*) FILTER (k) AS rows_after_cleanup, count(*) FILTER (NOT k) AS rows_removed, count(*) FILTER (is_removed_by_translation) AS removed_by_translation_failure,
        count(*) FILTER (NOT k AND NOT is_removed_by_translation) AS removed_by_final_cleanup, bool_and(detected_language = 'english') FILTER (k) AS all_comments_english,
        min(length(cleaned_comment_text)) FILTER (k) AS minimum_cleaned_length_chars, min({Q.hits('cleaned_comment_text', f'[^{Q._WS}]+')}) FILTER (k) AS minimum_cleaned_word_count,
        'READY' AS annotation_readiness FROM (SELECT *, NOT is_removed_in_final_cleanup AS k FROM tidy)""", *_GATED))
register("language_after_cleanup", lambda t: TR.language_after_cleanup(_translated(t)).select("detected_language", "n"), Q.with_comments(
    "SELECT detected_language, count(*) AS n FROM tidy WHERE NOT is_removed_in_final_cleanup GROUP BY 1", *_GATED))

# --- composite jobs ----------------------------------------------------------------
register("preprocess_comments", lambda t: jobs.preprocess(t.comments).table.select("comment_id", S.CLEANED, "product_query"),
         Q.with_flagged("SELECT comment_id, cleaned_comment_text, product_query FROM flagged WHERE NOT is_removed_by_cleaning"))
def _video_side(t):
    return t.documents.filter(F.col("doc_id") % PER_VIDEO == 0).select(
        F.concat(F.lit("v"), F.expr(f"cast(doc_id div {PER_VIDEO} as string)")).alias("video_id"), F.col("lang").alias("title"), F.col("source").alias("channel_name"),
        F.col("n_chars").alias("view_count"), (F.col("n_chars") % 10).alias("like_count"))


_EXPORT_SQL = """SELECT c.comment_id, c.product_query, c.video_id, v.lang AS video_title, v.source AS channel_name, v.n_chars AS view_count, v.n_chars % 10 AS video_like_count, c.like_count AS comment_like_count
  FROM {0} c LEFT JOIN documents v ON v.doc_id % 10 = 0 AND c.video_id = 'v' || (v.doc_id // 10)"""
_EXPORT_COLUMNS = ["comment_id", "product_query", "video_id", "video_title", "channel_name", "view_count", "video_like_count", "comment_like_count"]


def _exported(t):
    """Two landed files whose copies differ: the second file's text sorts first, the first file's stays."""
    def landed(copy: str, text) -> DataFrame:
        return t.comments.withColumns({"comment_text": text, "source_file": F.lit(copy), "source_row": F.col("doc_id")})

    both = landed("file1", F.concat(F.lit("z"), "comment_id")).unionByName(landed("file2", F.concat(F.lit("a"), "comment_id")))
    return jobs.export_master(_video_side(t), both, video_files=1, stage_dir=run_dir(t.spark, "export"))


register("export_master", lambda t: _exported(t).table.select(*_EXPORT_COLUMNS, "comment_text"),
         Q.with_comments(_EXPORT_SQL.format("comments").replace("SELECT c.comment_id", "SELECT 'z' || c.comment_id AS comment_text, c.comment_id", 1)))
register("export_report", lambda t: _exported(t).reports["master"], Q.with_comments(
    """SELECT count(DISTINCT product_query) AS product_count, 1 AS video_files_found, 2 AS comment_files_found, count(*) AS total_comments,
       (SELECT count(*) FROM documents WHERE doc_id % 10 = 0) AS total_videos, count(*) AS duplicate_comments_removed FROM comments"""))


# --- streaming ----------------------------------------------------------------------
def _ingest(t):
    out = run_dir(t.spark, "ingest")
    landed = stream.read_landed(t.spark, f"{t.dir}/documents.parque[t]", t.documents.schema)  # a file or a folder
    comments = comments_of(landed)
    for _ in range(2):  # the second run finds nothing new
        stream.incremental_ingest(comments, f"{out}/table", f"{out}/checkpoint", partitions=t.spark.sparkContext.defaultParallelism)
    return t.spark.read.parquet(f"{out}/table").select("comment_id", S.CLEANED, "detected_language")


register("incremental_ingest", _ingest, Q.with_flagged(
    "SELECT comment_id, cleaned_comment_text, detected_language FROM flagged JOIN det USING (comment_id) WHERE NOT is_removed_by_cleaning", _DETECTED))


def _stream_dedup(t):
    out = run_dir(t.spark, "dedup")
    events = t.events
    middle = events.agg(F.percentile_approx("ts", 0.5)).first()[0]
    # The newer half lands first; all events, months older ones among them, land in a second run.
    for part in (events.filter(F.col("ts") >= F.lit(middle)), events.union(events)):
        part.write.mode("append").parquet(f"{out}/landed")
        stream.stream_dedup(stream.read_landed(t.spark, f"{out}/landed", events.schema), "event_id", f"{out}/table", f"{out}/checkpoint")
    return t.spark.read.parquet(f"{out}/table").select("event_id", "event_type", "user_id")


register("stream_dedup", _stream_dedup, "SELECT DISTINCT event_id, event_type, user_id FROM events")
