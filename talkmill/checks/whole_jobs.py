"""Composite jobs with all their tables and reports, as (report, key, name, value) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from talkmill import schemas as S
from talkmill.checks import sql as Q
from talkmill.checks.bindings import lit
from talkmill.checks.facts import all_facts, facts, row_facts, sql_facts, sql_row_facts
from talkmill.checks.job_queries import _COMPETITORS, _DETECTED, _GATED, _MENTIONS, _landed, _video_side, raw
from talkmill.checks.registry import register
from talkmill.checks.table_queries import _CQ, _FLAGGED_ANNOTATIONS, _NOTED, _SHORT, _VQ, _BAD, _comment_quality, _long_sql, _video_quality
from talkmill.checks.text_queries import DICTIONARY
from talkmill.functions import lexicons as X
from talkmill.operators import language_audit as L, sampling as SA, translation as TR
from talkmill.plans import jobs
from talkmill.session import run_dir


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _md5(column: str):
    return F.md5(F.coalesce(column, F.lit(""))).alias(column)


def _names(labels: list[str]) -> list[str]:
    return [a.lower().replace(" ", "_") for a in labels]


# --- language audit -----------------------------------------------------------------
def _language_audit(t):
    done = jobs.language_audit(t.comments, stage_dir=run_dir(t.spark, "audit"))
    examples = done.reports["examples"].withColumn("example", _md5("example"))
    return _all(facts(done.table.select("comment_id", "detected_language"), "table", ["comment_id"]), facts(done.reports["distribution"], "distribution", ["detected_language"]),
                facts(examples, "examples", ["detected_language", "example_rank"]))


register("language_audit", _language_audit, Q.with_comments(" UNION ALL ".join([
    sql_facts("table", "det", "comment_id", {"detected_language": "detected_language"}),
    sql_facts("distribution", "(SELECT detected_language, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE * 100, 2) AS pct FROM det GROUP BY 1)", "detected_language", {"n": "n", "pct": "pct"}, ("pct",)),
    sql_facts("examples", f"(SELECT *, row_number() OVER (PARTITION BY detected_language ORDER BY comment_id) AS r FROM det WHERE {Q.strip('comment_text')} <> '')", "detected_language || '|' || r",
              {"example": f"md5({Q.strip('comment_text')})"}) + " WHERE r <= 5"]), _DETECTED))


# --- validation ---------------------------------------------------------------------
def _validation(t):
    done = jobs.validate(_video_quality(t), _comment_quality(t))
    longest = done["longest_comments"].withColumn("comment_text", _md5("comment_text"))
    return _all(facts(done["video_validation"], "video_validation", ["metric", "key"]), facts(done["comment_validation"], "comment_validation", ["metric", "key"]),
                *[facts(done[r], r) for r in ("video_profile", "comment_profile", "comments_per_video")],
                row_facts(longest, "longest_comments", ["comment_id", "video_id", "comment_text", "comment_length"]))


_VIDEO_CHECK = _long_sql("v", "video_id", ["video_id", "video_url", "published_at"],
                         [("invalid_urls", "", "count(*) FILTER (NOT regexp_matches(video_url, '(?i)^https?://'))"), ("invalid_timestamps", "published_at", _BAD.format("published_at"))])
_COMMENT_CHECK = _long_sql("q", "comment_id", ["comment_id", "video_id", "comment_text", "published_at", "updated_at"], [
    ("empty_comments", "", "count(*) FILTER (coalesce(comment_text, '') = '')"),
    ("whitespace_only_comments", "", f"count(*) FILTER (comment_text <> '' AND {Q.strip('comment_text')} = '')"),
    ("comments_shorter_than_3_characters", "", _SHORT), ("invalid_timestamps", "published_at", _BAD.format("published_at")), ("invalid_timestamps", "updated_at", _BAD.format("updated_at")),
    ("percentage_empty_comments", "", "round(count(*) FILTER (coalesce(comment_text, '') = '') / count(*)::DOUBLE * 100, 2)"),
    ("percentage_very_short_comments", "", f"round({_SHORT} / count(*)::DOUBLE * 100, 2)")])
_LENGTH = "length(coalesce(comment_text, ''))"
register("validation_job", _validation, Q.with_comments(" UNION ALL ".join([
    sql_facts("video_validation", f"({_VIDEO_CHECK})", "metric || '|' || key", {"value": "value"}, ("value",)),
    sql_facts("comment_validation", f"({_COMMENT_CHECK})", "metric || '|' || key", {"value": "value"}, ("value",)),
    sql_facts("video_profile", "(SELECT count(*) AS n FROM v)", "''", {"number_of_videos": "n", "unique_channels": "0", "average_views": "NULL", "average_likes": "NULL", "average_comments": "NULL"}),
    sql_facts("comment_profile", f"""(SELECT count(*) AS total_comments, round(CAST(sum({_LENGTH}) AS DOUBLE) / count(*)::DOUBLE, 2) AS average_comment_length,
        round(quantile_cont({_LENGTH}, 0.5), 2) AS median_comment_length, count(DISTINCT video_id) AS unique_videos_represented FROM q)""", "''",
        {c: c for c in ("total_comments", "average_comment_length", "median_comment_length", "unique_videos_represented")}, ("average_comment_length", "median_comment_length")),
    sql_facts("comments_per_video", """(SELECT count(*) AS videos_with_comments, min(n) AS min_comments_per_video, max(n) AS max_comments_per_video, round(sum(n)::DOUBLE / count(*)::DOUBLE, 2) AS average_comments_per_video,
        round(quantile_cont(n, 0.5), 2) AS median_comments_per_video FROM (SELECT count(*) AS n FROM q WHERE video_id IS NOT NULL GROUP BY video_id))""", "''",
        {c: c for c in ("videos_with_comments", "min_comments_per_video", "max_comments_per_video", "average_comments_per_video", "median_comments_per_video")}, ("average_comments_per_video", "median_comments_per_video")),
    sql_row_facts("longest_comments", f"(SELECT *, {_LENGTH} AS l FROM q ORDER BY l DESC, comment_id LIMIT 20)", ["comment_id", "video_id", "md5(coalesce(comment_text, ''))", "l"]),
]), _CQ, _VQ))


# --- translation ----------------------------------------------------------------------
def _translation(t):
    landed = t.comments.select("comment_id", _landed().alias("translation"))
    base = L.add_detected_language(t.comments.select("doc_id", "comment_id", "comment_text")).withColumn(S.CLEANED, raw())
    done = jobs.translate_and_cleanup(base, lambda d: TR.apply_translations(d, landed, ["comment_id"]), DICTIONARY, stage_dir=run_dir(t.spark, "translate"))
    table = done.table.select("comment_id", _md5(S.CLEANED), S.IS_TRANSLATED, S.REMOVED_BY_TRANSLATION)
    return all_facts({"table": (table, ["comment_id"]), "translation": (done.reports["translation"], []), "readiness": (done.reports["readiness"], []),
                      "translated_by_language": (done.reports["translated_by_language"], ["detected_language"])})


def _readiness_sql(source: str, kept: str) -> str:
    return f"""(SELECT count(*) AS rows_before_cleanup, count(*) FILTER (k) AS rows_after_cleanup, count(*) FILTER (NOT k) AS rows_removed, count(*) FILTER (is_removed_by_translation) AS removed_by_translation_failure,
        count(*) FILTER (NOT k AND NOT is_removed_by_translation) AS removed_by_final_cleanup, bool_and(detected_language = 'english') FILTER (k) AS all_comments_english,
        min(length(cleaned_comment_text)) FILTER (k) AS minimum_cleaned_length_chars, min({Q.hits('cleaned_comment_text', f'[^{Q._WS}]+')}) FILTER (k) AS minimum_cleaned_word_count,
        'READY' AS annotation_readiness FROM (SELECT *, {kept} AS k FROM {source}))"""


_READINESS = {c: c for c in ("rows_before_cleanup", "rows_after_cleanup", "rows_removed", "removed_by_translation_failure", "removed_by_final_cleanup", "all_comments_english",
                             "minimum_cleaned_length_chars", "minimum_cleaned_word_count", "annotation_readiness")}


def _translation_sql(source: str) -> str:
    counts = f"(SELECT count(*) AS total_comments, count(*) FILTER (is_translated) AS translated_comments, count(*) FILTER (is_removed_by_translation) AS removed_by_translation_failure FROM {source})"
    return sql_facts("translation", counts, "''", {c: c for c in ("total_comments", "translated_comments", "removed_by_translation_failure")}) + " UNION ALL " + sql_facts(
        "translated_by_language", f"(SELECT detected_language, count(*) AS n FROM {source} WHERE is_translated GROUP BY 1)", "detected_language", {"n": "n"})


_ROW = {S.CLEANED: "md5(coalesce(cleaned_comment_text, ''))", S.IS_TRANSLATED: "is_translated", S.REMOVED_BY_TRANSLATION: "is_removed_by_translation"}
register("translate_and_cleanup", _translation, Q.with_comments(" UNION ALL ".join([
    sql_facts("table", "(SELECT * FROM tidy WHERE NOT is_removed_in_final_cleanup)", "comment_id", _ROW), _translation_sql("tidy"),
    sql_facts("readiness", _readiness_sql("tidy", "NOT is_removed_in_final_cleanup"), "''", _READINESS)]), *_GATED))


# --- one product after another, in one job ---------------------------------------------
def _processed(t):
    landed = t.comments.select("comment_id", _landed().alias("translation"))
    done = jobs.process_products(t.comments.drop("text"), _video_side(t), lambda d: TR.apply_translations(d, landed, ["comment_id"]), DICTIONARY, stage_dir=run_dir(t.spark, "process"))
    table = done.table.select("comment_id", "product_query", _md5(S.CLEANED), "detected_language", "is_translated", "video_title")
    reports = {r: (done.reports[r], []) for r in ("translation", "readiness", "master")}
    return all_facts({"table": (table, ["comment_id"]), **reports, "translated_by_language": (done.reports["translated_by_language"], ["detected_language"]),
                      "products": (done.reports["products"].withColumn("present", F.lit(True)), ["product_query"])})


_KEPT_CODES = [part.replace("FROM det WHERE coalesce(comment_text", "FROM det SEMI JOIN (SELECT comment_id FROM flagged WHERE NOT is_removed_by_cleaning) USING (comment_id) WHERE coalesce(comment_text") for part in _GATED]
_PROCESSED = """pr AS (SELECT f.comment_id, f.product_query, f.video_id, x.detected_language, x.is_translated, x.is_removed_by_translation, v.lang AS video_title,
    CASE WHEN x.detected_language <> 'english' THEN x.cleaned_comment_text ELSE f.cleaned_comment_text END AS cleaned_comment_text, x.detected_language <> 'english' AND x.is_removed_in_final_cleanup AS gone
  FROM flagged f JOIN tidy x USING (comment_id) LEFT JOIN documents v ON v.doc_id % 10 = 0 AND f.video_id = 'v' || (v.doc_id // 10) WHERE NOT f.is_removed_by_cleaning)"""
register("process_product", _processed, Q.with_comments(" UNION ALL ".join([
    sql_facts("table", "(SELECT * FROM pr WHERE NOT gone)", "comment_id", {"product_query": "product_query", S.CLEANED: _ROW[S.CLEANED], "detected_language": "detected_language", "is_translated": "is_translated", "video_title": "video_title"}),
    _translation_sql("pr"), sql_facts("readiness", _readiness_sql("pr", "NOT gone"), "''", _READINESS),
    sql_facts("master", "(SELECT count(DISTINCT product_query) AS p, count(*) AS n, (SELECT count(*) FROM documents WHERE doc_id % 10 = 0) AS v FROM pr WHERE NOT gone)", "''",
              {"product_count": "p", "video_files_found": "1", "comment_files_found": "1", "total_comments": "n", "total_videos": "v", "duplicate_comments_removed": "0"}),
    sql_facts("products", "(SELECT DISTINCT product_query FROM pr WHERE NOT gone)", "product_query", {"present": "true"})]), Q.FLAGGED, *_KEPT_CODES, _PROCESSED))


# --- annotation -------------------------------------------------------------------------
def sample_sql(size: int, seed: int) -> str:
    """The product-balanced sample: quotas, then the rows left over in hash order."""
    return f"""sizes AS (SELECT product_query AS p, count(*) AS size FROM comments GROUP BY 1),
  quotas AS (SELECT p, least(target // cnt + CASE WHEN place <= target - target // cnt * cnt THEN 1 ELSE 0 END, size) AS quota FROM
    (SELECT p, size, CAST(least({size}, sum(size) OVER ()) AS BIGINT) AS target, count(*) OVER () AS cnt, row_number() OVER (ORDER BY p) AS place FROM sizes)),
  hashed AS (SELECT *, md5('{seed}:' || comment_id) AS h FROM comments),
  sampled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_query ORDER BY h, comment_id) AS r FROM hashed) JOIN quotas ON p = product_query ORDER BY r > quota, h, comment_id LIMIT {size})"""


def _setup(t):
    done = jobs.annotation_setup(t.comments, 47, 11)
    table = done.table.withColumn("comment_text", _md5("comment_text"))
    return all_facts({"table": (table, ["comment_id"]), "annotation": (done.reports["annotation"], [])})


_BLANK = ["sentiment_label", "aspect_label", "review_notes", *[f"is_{n.lower().replace(' ', '_')}" for n in X.NOTE_LABELS]]
_TEMPLATE = {c: "NULL" for c in S.ANNOTATION_METADATA} | {c: c for c in ("product_query", "video_id")} | {"comment_text": "md5(coalesce(comment_text, ''))"} | {c: "''" for c in _BLANK}
_TEMPLATE.pop("comment_id")
register("annotation_setup", _setup, Q.with_comments(" UNION ALL ".join([
    sql_facts("table", "sampled", "comment_id", _TEMPLATE),
    sql_facts("annotation", "(SELECT count(*) AS n FROM sampled)", "''", {"total_rows": "n", "labeled_rows": "0", "missing_sentiment_labels": "n", "missing_aspect_labels": "n"})]), sample_sql(47, 11)))
register("balanced_sample", lambda t: SA.balanced_sample(t.comments, "comment_id", 71).select("comment_id", "product_query"),
         Q.with_comments("SELECT comment_id, product_query FROM sampled", sample_sql(71, 42)))


def _analysis(t):
    done = jobs.annotation_analysis(t.flagged_annotations.withColumn(S.CLEANED, raw()))
    keys = {"sentiment_by_product": ["product_query"], "aspect_by_product": ["product_query"], "sentiment_by_aspect": ["aspect_label"], "aspect_by_note": ["review_notes"],
            "sentiment_by_note": ["review_notes"], "language_error_aspects": ["review_notes", "aspect_label"], "future_demand_sentiment": ["review_notes", "sentiment_label"],
            "overview": [], "flag_agreement": [], "consistency": []}
    review = ["other_sample", "spam_review"]
    return _all(*[facts(done[r], r, k) for r, k in keys.items()], *[row_facts(done[r], r, done[r].columns) for r in review])


def _crosstab(report: str, by: str, label: str, labels: list[str]) -> str:
    counts = ", ".join(f"count(*) FILTER ({label} = {lit(a)}) AS {n}" for a, n in zip(labels, _names(labels)))
    return sql_facts(report, f"(SELECT {by}, {counts} FROM noted WHERE {by} IS NOT NULL AND {label} IS NOT NULL GROUP BY 1)", by, {n: n for n in _names(labels)})


def _noted(report: str, note: str, label: str) -> str:
    return sql_facts(report, f"(SELECT review_notes, {label}, count(*) AS n FROM noted WHERE review_notes = {lit(note)} AND {label} IS NOT NULL GROUP BY 1, 2)", f"review_notes || '|' || {label}", {"n": "n"})


_AGREEMENT = """(SELECT count(*) FILTER (ls) AS labeled_spam, count(*) FILTER (is_spam) AS flagged_spam, count(*) FILTER (ls AND is_spam) AS both, count(*) FILTER (ls AND NOT is_spam) AS label_only,
  count(*) FILTER (NOT ls AND is_spam) AS flag_only, count(*) FILTER (ls AND is_short_comment) AS short_and_labeled, count(*) FILTER (ls AND is_single_word) AS single_word_and_labeled FROM fa)"""
_CONSISTENT = """(SELECT *, CASE WHEN question_rows = 0 THEN 0 ELSE round(question_neutral / question_rows::DOUBLE * 100, {digits}) END AS question_neutral_pct,
  CASE WHEN unrelated_rows = 0 THEN 0 ELSE round(unrelated_other_spam / unrelated_rows::DOUBLE * 100, {digits}) END AS unrelated_other_spam_pct FROM
  (SELECT count(*) FILTER (review_notes = 'Question') AS question_rows, count(*) FILTER (review_notes = 'Question' AND sentiment_label = 'Neutral') AS question_neutral,
   count(*) FILTER (review_notes = 'Unrelated') AS unrelated_rows, count(*) FILTER (review_notes = 'Unrelated' AND aspect_label IN ('Other', 'Spam')) AS unrelated_other_spam FROM noted))"""
_FULL = f"spammy AS (SELECT n.*, {Q.is_spam('comment_text')} AS is_spam FROM noted n)"
register("annotation_analysis", _analysis, Q.with_annotated(" UNION ALL ".join([
    sql_facts("overview", "(SELECT count(*) AS total_rows, count(DISTINCT product_query) AS products, count(sentiment_label) AS sentiment_label_filled, count(aspect_label) AS aspect_label_filled, count(review_notes) AS review_notes_filled FROM noted)",
              "''", {c: c for c in ("total_rows", "products", "sentiment_label_filled", "aspect_label_filled", "review_notes_filled")}),
    _crosstab("sentiment_by_product", "product_query", "sentiment_label", X.SENTIMENT_LABELS), _crosstab("aspect_by_product", "product_query", "aspect_label", X.ASPECT_LABELS),
    _crosstab("sentiment_by_aspect", "aspect_label", "sentiment_label", X.SENTIMENT_LABELS), _crosstab("aspect_by_note", "review_notes", "aspect_label", X.ASPECT_LABELS),
    _crosstab("sentiment_by_note", "review_notes", "sentiment_label", X.SENTIMENT_LABELS),
    _noted("language_error_aspects", X.NOTE_LABELS[2], "aspect_label"), _noted("future_demand_sentiment", X.NOTE_LABELS[1], "sentiment_label"),
    sql_facts("flag_agreement", _AGREEMENT, "''", {c: f'"{c}"' for c in ("labeled_spam", "flagged_spam", "both", "label_only", "flag_only", "short_and_labeled", "single_word_and_labeled")}),
    sql_facts("consistency", _CONSISTENT.format(digits=6), "''", {c: c for c in ("question_rows", "question_neutral", "unrelated_rows", "unrelated_other_spam", "question_neutral_pct", "unrelated_other_spam_pct")},
              ("question_neutral_pct", "unrelated_other_spam_pct")),
    sql_row_facts("other_sample", "(SELECT * FROM noted WHERE aspect_label = 'Other' ORDER BY md5('42:' || comment_id), comment_id LIMIT 15)",
                  ["product_query", "sentiment_label", "review_notes", "left(comment_text, 120)", "left(comment_text, 120)"]),
    sql_row_facts("spam_review", "(SELECT * FROM spammy WHERE aspect_label = 'Spam')", ["product_query", "sentiment_label", "review_notes", "is_spam", "left(comment_text, 150)"]),
]), _NOTED, _FLAGGED_ANNOTATIONS, _FULL))


def _audit(t):
    done = jobs.aspect_audit(t.annotated)
    return all_facts({"aspect_by_product": (done["aspect_by_product"], ["product_query"]), "quality": (done["quality"], ["aspect_label"]), "buckets": (done["buckets"], ["aspect_label"])})


register("aspect_audit", _audit, Q.with_annotated(" UNION ALL ".join([
    _crosstab("aspect_by_product", "product_query", "aspect_label", X.ASPECT_LABELS),
    sql_facts("quality", """(SELECT *, round(has_notes / n::DOUBLE * 100, 1) AS notes_ratio, round(is_translated / n::DOUBLE * 100, 1) AS translated_ratio FROM
      (SELECT aspect_label, count(*) AS n, count(review_notes) AS has_notes, count(*) FILTER (is_translated) AS is_translated FROM noted WHERE aspect_label IS NOT NULL GROUP BY 1))""", "aspect_label",
              {c: c for c in ("n", "has_notes", "is_translated", "notes_ratio", "translated_ratio")}, ("notes_ratio", "translated_ratio")),
    sql_facts("buckets", """(SELECT aspect_label, n, CASE WHEN n <= 10 THEN 'rare' WHEN n <= 20 THEN 'low' ELSE 'adequate' END AS bucket, max(n) OVER () / n::DOUBLE AS imbalance,
      n / (sum(n) OVER ())::DOUBLE * 100 AS pct FROM (SELECT aspect_label, count(*) AS n FROM noted WHERE aspect_label IS NOT NULL GROUP BY 1))""", "aspect_label",
              {c: c for c in ("n", "bucket", "imbalance", "pct")}, ("imbalance", "pct")),
]), "noted AS (SELECT * FROM annotated)"))


# --- insights ---------------------------------------------------------------------------
def _insights(t):
    done = jobs.product_insights(t.comments.withColumn(S.CLEANED, raw()), stage_dir=run_dir(t.spark, "insights"))
    sentiments = F.array_join(F.transform(F.map_entries("sentiment_distribution"), lambda e: F.concat_ws(":", e["key"], e["value"]["count"], F.round(e["value"]["pct"], 1).cast("decimal(5,1)"))), ",")
    rivals = F.array_join(F.transform("competitor_mentions", lambda r: F.concat_ws(":", r["competitor"], r["mentions"])), ",")
    texts = {f"{s}_texts": F.md5(F.array_join(F.col("sample_comments")[s], "|")) for s in _names(X.SENTIMENT_LABELS)}
    table = done.table.select("product", "total_comments", F.nullif(sentiments, F.lit("")).alias("sentiments"), F.nullif(rivals, F.lit("")).alias("rivals"), *[c.alias(n) for n, c in texts.items()])
    return all_facts({"table": (table, ["product"]), "summary": (done.reports["summary"], ["product_query"])})


_PRODUCT = """(SELECT product_query AS product, (SELECT count(*) FROM comments c WHERE c.product_query = p.product_query) AS total_comments,
  (SELECT string_agg(s || ':' || n || ':' || CAST(round(n / total::DOUBLE * 100, 1) AS DECIMAL(5,1)), ',' ORDER BY s) FROM
     (SELECT lower(predicted_sentiment) AS s, count(*) AS n, sum(count(*)) OVER () AS total FROM scored q WHERE q.product_query = p.product_query GROUP BY 1)) AS sentiments,
  (SELECT string_agg(competitor || ':' || mentions, ',' ORDER BY r) FROM mentioned m WHERE m.product_query = p.product_query AND r <= 10) AS rivals, {texts} FROM (SELECT DISTINCT product_query FROM comments) p)"""
_SHOWN = """shown AS (SELECT product_query, lower(predicted_sentiment) AS s, comment_text, row_number() OVER (PARTITION BY product_query, predicted_sentiment ORDER BY comment_id) AS r
  FROM scored WHERE comment_text IS NOT NULL)"""
_TEXTS = ", ".join(f"md5(coalesce((SELECT string_agg(comment_text, '|' ORDER BY r) FROM shown w WHERE w.product_query = p.product_query AND s = {lit(s)} AND r <= 5), '')) AS {s}_texts" for s in _names(X.SENTIMENT_LABELS))
_SUMMARY = """(SELECT *, round(positive / total_comments::DOUBLE * 100, 1) AS positive_pct, round(negative / total_comments::DOUBLE * 100, 1) AS negative_pct FROM
  (SELECT product_query, count(*) AS total_comments, count(*) FILTER (predicted_sentiment = 'Positive') AS positive, count(*) FILTER (predicted_sentiment = 'Negative') AS negative,
   max(m.competitor) AS competitor, max(m.mentions) AS mentions FROM scored LEFT JOIN (SELECT product_query, competitor, mentions FROM mentioned WHERE r = 1) m USING (product_query) GROUP BY 1))"""
register("product_insights", _insights, Q.with_scored(" UNION ALL ".join([
    sql_facts("table", _PRODUCT.format(texts=_TEXTS), "product", {c: c for c in ("total_comments", "sentiments", "rivals", *[f"{s}_texts" for s in _names(X.SENTIMENT_LABELS)])}),
    sql_facts("summary", _SUMMARY, "product_query", {c: c for c in ("total_comments", "positive", "negative", "competitor", "mentions", "positive_pct", "negative_pct")}, ("positive_pct", "negative_pct")),
]), _COMPETITORS, _MENTIONS, _SHOWN))
