"""Column names and table schemas of the data model (stable public names)."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT = "comment_text"
CLEANED = "cleaned_comment_text"
LANGUAGE = "detected_language"
PRODUCT = "product_query"

IS_SPAM = "is_spam"
IS_EMPTY = "is_empty"
IS_DELETED = "is_deleted"
IS_SHORT = "is_short_comment"
IS_SINGLE_WORD = "is_single_word"
IS_REMOVED = "is_removed_by_cleaning"
IS_TRANSLATED = "is_translated"
REMOVED_BY_TRANSLATION = "is_removed_by_translation"
REMOVED_IN_CLEANUP = "is_removed_in_final_cleanup"


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _L, _B, _D = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType()

VIDEO_SEARCH = _table(
    ("product_query", _S), ("video_id", _S), ("video_url", _S), ("title", _S),
    ("description", _S), ("channel_name", _S), ("channel_id", _S), ("published_at", _S),
)
VIDEOS = _table(
    ("video_id", _S), ("product_query", _S), ("title", _S), ("video_url", _S),
    ("channel_name", _S), ("published_at", _S), ("view_count", _L), ("like_count", _L),
    ("comment_count", _L), ("duration", _S), ("tags", T.ArrayType(_S)), ("category_id", _S),
)
COMMENTS = _table(
    ("product_query", _S), ("video_id", _S), ("video_url", _S), ("video_title", _S),
    ("comment_id", _S), ("author_name", _S), ("comment_text", _S), ("like_count", _L),
    ("published_at", _S), ("updated_at", _S),
)
# Column order of the exported master table.
MASTER = _table(
    ("product_query", _S), ("video_id", _S), ("video_title", _S), ("video_url", _S),
    ("channel_name", _S), ("published_at", _S), ("view_count", _L), ("comment_count", _L),
    ("video_like_count", _L), ("comment_id", _S), ("author_name", _S), ("comment_text", _S),
    ("cleaned_comment_text", _S), ("comment_like_count", _L), ("detected_language", _S),
    ("is_empty", _B), ("is_deleted", _B), ("is_short_comment", _B), ("is_single_word", _B),
    ("is_spam", _B), ("is_removed_by_cleaning", _B), ("is_translated", _B), ("updated_at", _S),
)
VIDEO_SIDE = [
    "video_id", "product_query", "video_title", "video_url", "channel_name",
    "published_at", "view_count", "comment_count", "video_like_count",
]
ANNOTATION_METADATA = [
    "product_query", "video_id", "video_title", "channel_name", "comment_id",
    "comment_text", "cleaned_comment_text", "comment_like_count", "detected_language",
]
TRAINING_SET = _table(
    ("cleaned_comment_text", _S), ("aspect_label", _S), ("source", _S), ("confidence", _D),
)
