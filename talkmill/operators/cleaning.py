"""Flag and filter low-value comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from talkmill import schemas as S
from talkmill.functions import flags as G
from talkmill.functions.binding import with_computed
from talkmill.functions.text import clean_text

FLAG_COUNTS = {
    S.IS_SPAM: "spam_count",
    S.IS_EMPTY: "empty_count",
    S.IS_DELETED: "deleted_count",
    S.IS_SHORT: "short_comment_count",
    S.IS_SINGLE_WORD: "single_word_count",
}


def flag_comments(df: DataFrame, text: str = S.TEXT) -> DataFrame:
    """Cleaned text and six flags. Without a text column every row is marked removed."""
    if text not in df.columns:
        fixed = {
            S.CLEANED: F.lit(""), S.IS_EMPTY: F.lit(True), S.IS_DELETED: F.lit(False),
            S.IS_SHORT: F.lit(True), S.IS_SINGLE_WORD: F.lit(True), S.IS_SPAM: F.lit(False),
            S.IS_REMOVED: F.lit(True),
        }
        return df.withColumns(fixed)
    raw, cleaned = F.col(text), F.col(S.CLEANED)
    flagged = with_computed(with_computed(df, {S.CLEANED: clean_text(raw)}), {
        S.IS_EMPTY: G.is_empty(cleaned),
        S.IS_DELETED: G.is_deleted(raw),
        S.IS_SHORT: G.is_short(cleaned),
        S.IS_SINGLE_WORD: G.is_single_word(cleaned),
        S.IS_SPAM: G.is_spam(raw),
    })
    removed = (
        F.col(S.IS_EMPTY) | F.col(S.IS_DELETED) | F.col(S.IS_SHORT)
        | F.col(S.IS_SINGLE_WORD) | F.col(S.IS_SPAM)
    )
    return flagged.withColumn(S.IS_REMOVED, removed)


def keep_useful(flagged: DataFrame) -> DataFrame:
    return flagged.filter(~F.col(S.IS_REMOVED))


def preprocess_comments(df: DataFrame, text: str = S.TEXT) -> DataFrame:
    """Flagged comments without the low-value rows."""
    return keep_useful(flag_comments(df, text))


def _flag_counts(df: DataFrame) -> list:
    return [
        (F.count_if(F.col(flag)) if flag in df.columns else F.lit(0).cast("bigint")).alias(name)
        for flag, name in FLAG_COUNTS.items()
    ]


def report_columns(flagged: DataFrame) -> list:
    """Row and flag counts before the filter, as aggregates."""
    kept = F.count_if(~F.col(S.IS_REMOVED)) if S.IS_REMOVED in flagged.columns else F.count("*")
    return [
        F.count("*").alias("original_rows"), kept.alias("processed_rows"), *_flag_counts(flagged),
        (F.count("*") - kept).alias("rows_removed_by_cleaning"),
    ]


def preprocessing_report(flagged: DataFrame, by: str | None = None) -> DataFrame:
    """Row and flag counts before the filter; with ``by``, per value plus a null-keyed total."""
    counts = report_columns(flagged)
    if by is None:
        return flagged.agg(*counts)
    # Aggregate once per value, then total the few result rows.
    per_value = flagged.groupBy(by).agg(*counts)
    sums = [F.sum(c).alias(c) for c in per_value.columns if c != by]
    totals = per_value.agg(*sums).withColumn("scope", F.lit("total")).withColumn(by, F.lit(None).cast("string"))
    return per_value.withColumn("scope", F.lit("product")).unionByName(totals)


def analysis_rows(df: DataFrame) -> DataFrame:
    """Rows used for exploration: not spam, not empty, with cleaned text."""
    return df.filter((F.col(S.IS_SPAM) == False) & (F.col(S.IS_EMPTY) == False) & F.col(S.CLEANED).isNotNull())  # noqa: E712


def browse(df: DataFrame, min_likes: int, sentiment: str | None = None) -> DataFrame:
    """Optional sentiment, at least ``min_likes`` likes, with cleaned text."""
    kept = df.filter((F.col("comment_like_count") >= min_likes) & F.col(S.CLEANED).isNotNull())
    return kept if sentiment in (None, "All") else kept.filter(F.col("predicted_sentiment") == sentiment)
