"""Composite jobs: what a user calls.

Jobs return lazy DataFrames. Several results of one job (a table and its reports) would each
run the whole plan again, so jobs with costly steps take a ``stage_dir``: a folder shared by
all executors where a step's table is written once and read back. A written table also ends
the lineage, so a lost executor does not replay earlier steps.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from talkmill import schemas as S
from talkmill.functions.lexicons import ASPECT_LABELS, NOTE_LABELS, SENTIMENT_LABELS
from talkmill.functions.text import product_slug
from talkmill.operators import annotation as A, cleaning, insights, language_audit as L, master as M
from talkmill.operators import profiling as P, quality as Q, sampling, translation as TR
from talkmill.operators.conform import annotation_template, note_flags
from talkmill.sources import commits, files


@dataclass
class Stage:
    """A table and the reports about it."""

    table: DataFrame
    reports: dict[str, DataFrame]

    def write(self, path: str, partition_by: list[str] = ()) -> None:
        files.write_parquet(self.table, f"{path}/table", partition_by)
        for name, report in self.reports.items():
            files.write_report_json(report, f"{path}/reports/{name}")


def staged(df: DataFrame, stage_dir: str | None, name: str) -> DataFrame:
    """The table after a round trip through ``stage_dir``; unchanged without one.

    Every call writes a folder of its own, so two runs with one ``stage_dir`` do not meet.
    """
    if stage_dir is None:
        return df
    at = f"{stage_dir}/{name}-{uuid.uuid4().hex}"
    files.write_parquet(df, at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def staged_with(df: DataFrame, stage_dir: str | None, name: str, reports: dict[str, list[Column]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A staged table and one-row reports about it, filled while it is written: no second scan.

    Without a ``stage_dir`` the reports are aggregates over the table.
    """
    empty = {r: df.agg(*columns) for r, columns in reports.items()}
    if stage_dir is None:
        return df, empty
    seen = Observation(name)
    metrics = [c.alias(f"{r} {field}") for r, columns in reports.items() for c, field in zip(columns, empty[r].columns)]
    table = staged(df.observe(seen, *metrics), stage_dir, name)
    got = seen.get
    rows = {r: [tuple(got[f"{r} {field}"] for field in plan.columns)] for r, plan in empty.items()}
    return table, {r: df.sparkSession.createDataFrame(rows[r], plan.schema) for r, plan in empty.items()}


def language_audit(comments: DataFrame, key: str = "comment_id", stage_dir: str | None = None) -> Stage:
    audited = staged(L.add_detected_language(comments), stage_dir, "language_audited")
    return Stage(audited, {
        "distribution": L.language_distribution(audited), "examples": L.top_examples(audited, key, two_pass=stage_dir is not None),
    })


def preprocess(comments: DataFrame, by: str | None = None, stage_dir: str | None = None) -> Stage:
    """Kept comments; the report counts flags before the filter, while the flagged table is stored."""
    flagged = cleaning.flag_comments(comments)
    if by is not None:
        stored = staged(flagged, stage_dir, "flagged")
        return Stage(cleaning.keep_useful(stored), {"preprocessing": cleaning.preprocessing_report(stored, by)})
    stored, reports = staged_with(flagged, stage_dir, "flagged", {"preprocessing": cleaning.report_columns(flagged)})
    return Stage(cleaning.keep_useful(stored), reports)


def validate(videos: DataFrame, comments: DataFrame) -> dict[str, DataFrame]:
    """Validation and profile of both tables."""
    return {
        "video_validation": Q.validate_videos(videos), "comment_validation": Q.validate_comments(comments),
        "video_profile": P.profile_videos(videos), "comment_profile": P.profile_comments(comments),
        "longest_comments": P.top_longest(comments), "comments_per_video": P.comments_per_video_summary(comments),
    }


def validate_latest(spark: SparkSession, video_dir: str, comment_dir: str) -> dict[str, DataFrame]:
    """Validation of the newest landed files."""
    return validate(
        files.latest_dataset(spark, video_dir, "*.parquet"), files.latest_dataset(spark, comment_dir, "*.parquet")
    )


def translate_and_cleanup(comments: DataFrame, translate: Callable[[DataFrame], DataFrame], dictionary: dict[str, str] | DataFrame,
                          key: str = "comment_id", stage_dir: str | None = None) -> Stage:
    flagged = TR.flag_final_cleanup(TR.translate_comments(comments, translate, dictionary, key))
    table, reports = staged_with(flagged, stage_dir, "translated", {"translation": TR.translation_columns(flagged), "readiness": TR.readiness_columns(flagged)})
    return Stage(table.filter(~F.col(S.REMOVED_IN_CLEANUP)), {
        "translation": reports["translation"], "translated_by_language": TR.translated_by_language(table), "readiness": TR.judged_readiness(reports["readiness"]),
    })


def export_master(videos: DataFrame, comments: DataFrame, video_files: int | None = None, comment_files: int | None = None,
                  order: list | None = None, stage_dir: str | None = None) -> Stage:
    """Joined, deduplicated master table; of equal ids the first in file order stays.

    File counts are taken from the tables where they are not given. Row counts come from the
    writes of the two steps, where there is a ``stage_dir``.
    """
    video_files = M.count_files(videos) if video_files is None else video_files
    comment_files = M.count_files(comments) if comment_files is None else comment_files
    n = {"rows": [F.count("*").alias("n")]}
    joined, before = staged_with(M.build_master(videos, comments, keep_provenance=True), stage_dir, "joined", n)
    unique, after = staged_with(M.remove_duplicate_comments(joined, order), stage_dir, "unique", n)
    return Stage(unique, {
        "master": M.master_report(unique, videos, video_files, comment_files, joined, None if stage_dir is None else (before["rows"], after["rows"])), "products": M.products(unique),
    })


def run_export(spark: SparkSession, video_dir: str, comment_dir: str, out: str, pattern: str = "*.parquet") -> Stage:
    """The export as a whole: find the files, join, remove duplicates, write Parquet, CSV and reports under ``out``."""
    videos, comments = (files.scan_parquet_glob(spark, d, pattern, provenance=True) for d in (video_dir, comment_dir))
    done = export_master(videos, comments, stage_dir=f"{out}/steps")
    done.write(out)
    files.write_csv(done.table, f"{out}/csv")
    return done


def annotation_setup(master: DataFrame, sample_size: int = 300, seed: int = 42) -> Stage:
    template = annotation_template(sampling.balanced_sample(master, "comment_id", sample_size, seed))
    return Stage(template, {"annotation": A.annotation_report(template)})


def product_insights(master: DataFrame, stage_dir: str | None = None) -> Stage:
    scored = staged(insights.add_rule_sentiment(master), stage_dir, "scored")
    return Stage(insights.product_insights(scored, two_pass=stage_dir is not None), {"summary": insights.insight_summary(scored)})


def process_products(raw_comments: DataFrame, videos: DataFrame, translate: Callable[[DataFrame], DataFrame],
                     dictionary: dict[str, str] | DataFrame, done: DataFrame | None = None, stage_dir: str | None = None, out: str | None = None) -> Stage:
    """Audit, clean, translate and join all products that are not processed yet, together.

    With ``out`` the products are written there and committed one by one in a manifest, which is
    then what "processed" means: a run that died half-way is done again.
    """
    slugged = raw_comments.withColumn("product_slug", product_slug(F.col(S.PRODUCT)))
    if out is not None:
        todo = commits.still_to_do(slugged, out)
    else:
        todo = slugged if done is None else files.skip_processed(slugged, done)
    kept = staged(cleaning.preprocess_comments(L.add_detected_language(todo)), stage_dir, "kept")
    cleaned = translate_and_cleanup(kept, translate, dictionary, stage_dir=stage_dir)
    exported = export_master(videos, cleaned.table, comment_files=M.count_files(todo), stage_dir=stage_dir)
    if out is not None:
        commits.write_products(exported.table.withColumn("product_slug", product_slug(F.col(S.PRODUCT))), out)
    return Stage(exported.table, {**cleaned.reports, **exported.reports})


def annotation_analysis(annotated: DataFrame, key: str = "comment_id", seed: int = 42) -> dict[str, DataFrame]:
    """The label audit: overview, crosstabs, flag agreement, review samples, consistency."""
    rows = note_flags(annotated)
    others = rows.filter(F.col("aspect_label") == "Other")
    return {
        "overview": A.annotation_overview(rows, ["sentiment_label", "aspect_label", "review_notes"]),
        "sentiment_by_product": A.crosstab(rows, S.PRODUCT, "sentiment_label", SENTIMENT_LABELS),
        "aspect_by_product": A.crosstab(rows, S.PRODUCT, "aspect_label", ASPECT_LABELS),
        "sentiment_by_aspect": A.crosstab(rows, "aspect_label", "sentiment_label", SENTIMENT_LABELS),
        "aspect_by_note": A.crosstab(rows, "review_notes", "aspect_label", ASPECT_LABELS),
        "sentiment_by_note": A.crosstab(rows, "review_notes", "sentiment_label", SENTIMENT_LABELS),
        "flag_agreement": A.flag_mismatch(rows),
        "other_sample": A.review_table(
            sampling.random_sample(others, key, 15, seed), [S.PRODUCT, "sentiment_label", "review_notes"],
            {S.TEXT: 120, S.CLEANED: 120},
        ),
        "spam_review": A.review_table(
            rows.filter(F.col("aspect_label") == "Spam"), [S.PRODUCT, "sentiment_label", "review_notes", "is_spam"],
            {S.TEXT: 150},
        ),
        "consistency": A.consistency_checks(rows),
        "language_error_aspects": A.note_distribution(rows.filter(F.col("review_notes") == NOTE_LABELS[2]), "aspect_label"),
        "future_demand_sentiment": A.note_distribution(rows.filter(F.col("review_notes") == NOTE_LABELS[1]), "sentiment_label"),
    }


def aspect_audit(annotated: DataFrame) -> dict[str, DataFrame]:
    return {
        "aspect_by_product": A.crosstab(annotated, S.PRODUCT, "aspect_label", ASPECT_LABELS),
        "quality": A.aspect_quality(annotated),
        "buckets": A.class_buckets(annotated, "aspect_label"),
    }
