"""Jobs that remember: translation memory, committed products, reports filled while writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from talkmill import schemas as S
from talkmill.checks import sql as Q
from talkmill.checks.facts import all_facts, sql_facts
from talkmill.checks.job_queries import _DETECTED, _WITH_CODES, _audited, _echo_translator, _landed, _video_side
from talkmill.checks.registry import register
from talkmill.checks.table_queries import _REPORT
from talkmill.checks.text_queries import DICTIONARY
from talkmill.checks.whole_jobs import _KEPT_CODES, _PROCESSED, _ROW
from talkmill.functions.text import product_slug
from talkmill.operators import translation as TR
from talkmill.operators.translation_memory import remembered, translate_once
from talkmill.plans import jobs
from talkmill.session import run_dir
from talkmill.sources import commits


# --- translation memory ---------------------------------------------------------------
def _twice(t) -> DataFrame:
    """Two copies of every row, in two runs; the second run finds what the first has translated."""
    memory = run_dir(t.spark, "memory")
    routed = TR.resolve_source_code(TR.route_non_english(_audited(t)), "comment_id").select("comment_id", "comment_text", "source_code")
    half = routed.where(F.crc32("comment_id") % 2 == 0)
    translate_once(half.union(half), _echo_translator(), memory).count()
    done = translate_once(routed.union(routed), _echo_translator(), memory)
    kept = remembered(t.spark, memory).select(F.lit("memory").alias("comment_id"), F.concat(F.hex("_digest"), F.lit(" "), "_code").alias("translation"), F.lit(False).alias("translation_failed"))
    return done.select("comment_id", F.md5("translation").alias("translation"), "translation_failed").unionByName(kept)


_DONE = """SELECT comment_id, md5(CASE WHEN source_code IS NULL THEN NULL WHEN source_code = 'hin_Deva' THEN coalesce(comment_text, '') ELSE source_code || ' ' || coalesce(comment_text, '') END) AS translation,
  coalesce(source_code = 'hin_Deva', false) AS translation_failed FROM coded"""
register("translate_once", _twice, Q.with_comments(
    f"{_DONE} UNION ALL {_DONE} UNION ALL SELECT DISTINCT 'memory', upper(sha256(coalesce(comment_text, ''))) || ' ' || source_code, false FROM coded WHERE source_code IS NOT NULL AND source_code <> 'hin_Deva'", _DETECTED, _WITH_CODES))


# --- committed products ------------------------------------------------------------------
def _resumed(t) -> DataFrame:
    """A run over some products, one that died before its commit, and one that does the rest."""
    out, stage = run_dir(t.spark, "products"), run_dir(t.spark, "process")
    landed = t.comments.select("comment_id", _landed().alias("translation"))

    def process(comments: DataFrame) -> None:
        jobs.process_products(comments, _video_side(t), lambda d: TR.apply_translations(d, landed, ["comment_id"]), DICTIONARY, stage_dir=stage, out=out)

    comments = t.comments.drop("text")
    process(comments.where("product_query IN ('Steam Deck', 'Iphone 17')"))
    dead = comments.limit(5).select("comment_id", "product_query", product_slug(F.col("product_query")).alias("product_slug"))
    dead.write.partitionBy("product_slug").parquet(f"{out}/data/run=dead")
    # The committed products come again, with other texts; they are not done again.
    process(comments.withColumn("comment_text", F.when(F.col("product_query") == "Steam Deck", F.lit("another text of it")).otherwise(F.col("comment_text"))))
    table = commits.read_products(t.spark, out)
    manifest = commits.committed(t.spark, out)
    return all_facts({"table": (table.select("comment_id", "product_query", F.md5(F.coalesce(S.CLEANED, F.lit(""))).alias(S.CLEANED), "detected_language", "is_translated"), ["comment_id"]),
                      "manifest": (manifest.select("product_slug", "rows"), ["product_slug"])})


register("product_commits", _resumed, Q.with_comments(" UNION ALL ".join([
    sql_facts("table", "(SELECT * FROM pr WHERE NOT gone)", "comment_id", {"product_query": "product_query", S.CLEANED: _ROW[S.CLEANED], "detected_language": "detected_language", "is_translated": "is_translated"}),
    sql_facts("manifest", f"(SELECT {Q.slug('product_query')} AS slug, count(*) AS n FROM pr WHERE NOT gone GROUP BY 1)", "slug", {"rows": "n"})]), Q.FLAGGED, *_KEPT_CODES, _PROCESSED))


# --- reports in the pass that writes -------------------------------------------------------
register("observed_preprocessing", lambda t: jobs.preprocess(t.comments, stage_dir=run_dir(t.spark, "flagged")).reports["preprocessing"], Q.with_flagged(f"SELECT {_REPORT} FROM flagged"))
