"""Schema conformance: fixed column sets, renames, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from talkmill import schemas as S
from talkmill.functions.labels import normalize_note, note_columns
from talkmill.operators.dedup import keep_first


def ensure_columns(df: DataFrame, schema: T.StructType = S.MASTER) -> DataFrame:
    """Exactly the columns of ``schema`` in its order; missing ones are null."""
    return df.select(*[
        F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema
    ])


def rename_if_free(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename columns whose target name is not taken yet."""
    for old, new in names.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def rename_comment_columns(df: DataFrame) -> DataFrame:
    return rename_if_free(df, {"like_count": "comment_like_count", "title": "video_title"})


def prepare_videos(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Video side of the master join: renamed, one row per video_id (the first in file order, if known), at most nine columns."""
    renamed = rename_if_free(df, {"title": "video_title", "like_count": "video_like_count"})
    if "video_id" in renamed.columns:
        known = [c for c in ("source_file", "source_row") if c in renamed.columns]
        rest = order or known or [c for c in S.VIDEO_SIDE[1:] if c in renamed.columns]
        renamed = keep_first(renamed, "video_id", [F.col(c) for c in rest])
    return renamed.select(*[c for c in S.VIDEO_SIDE if c in renamed.columns])


def annotation_template(df: DataFrame) -> DataFrame:
    """Metadata columns (null when absent) and empty label columns."""
    metadata = [
        F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
        for c in S.ANNOTATION_METADATA
    ]
    blanks = ["sentiment_label", "aspect_label", "review_notes", *note_columns(F.lit(""))]
    return df.select(*metadata, *[F.lit("").alias(c) for c in blanks])


def note_flags(df: DataFrame, notes: str = "review_notes") -> DataFrame:
    """Normalised notes and one 0/1 column per note label."""
    normalized = df.withColumn(notes, normalize_note(F.col(notes)))
    return normalized.withColumns(note_columns(F.col(notes)))


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows of all tables; columns missing on one side are null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result
