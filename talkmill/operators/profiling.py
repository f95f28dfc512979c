"""Profiles and exploratory summaries.

Exact quantiles run over a value histogram: rows are first counted per distinct value; running
totals over ranges of values (:mod:`talkmill.operators.ranks`) find the values at their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from talkmill import schemas as S
from talkmill.functions.labels import coerce_numeric
from talkmill.operators.ranks import quantiles, value_counts_of


def value_histogram(df: DataFrame, value: Column, by: list[str] = ()) -> DataFrame:
    """(value, n) per distinct non-null value."""
    return df.select(*by, value.alias("value")).filter("value IS NOT NULL").groupBy(*by, "value").agg(
        F.count("*").alias("n")
    )


def _weighted_sum(value: Column) -> Column:
    # Decimal sums stay exact and cannot overflow.
    return F.sum((value * F.col("n")).cast("decimal(38,0)")).cast("double")


def _mean(value: Column) -> Column:
    return F.when(F.sum("n") > 0, _weighted_sum(value) / F.sum("n").cast("double"))


def describe(df: DataFrame, value: Column) -> DataFrame:
    """count, mean, sample standard deviation, min, quartiles and max of a numeric column.

    Whole numbers are summed exactly. No task holds the column, also where all values differ.
    """
    hist = value_counts_of(df, value)
    v, n = F.col("value"), F.sum("n").cast("double")
    if isinstance(hist.schema["value"].dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
        each = v.cast("double")
        total, squares = F.sum(each * F.col("n")), F.sum(each * each * F.col("n"))
    else:
        total, squares = _weighted_sum(v.cast("decimal(20,0)")), F.sum(
            (v.cast("decimal(19,0)") * v.cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")).cast("decimal(38,0)")
        ).cast("double")
    moments = hist.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"), (total / n).alias("mean"),
        F.when(n > 1, F.sqrt((squares - total * total / n) / (n - 1))).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    q = quantiles(hist, [0.25, 0.5, 0.75]).scalar()
    return moments.withColumn("q", q).select("count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def _median(hist: DataFrame) -> Column:
    return quantiles(hist, [0.5]).scalar()[0]


def text_length_summary(df: DataFrame, column: str) -> DataFrame:
    """count, mean and median length of a text column."""
    hist = value_counts_of(df, F.length(column))
    return hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), _mean(F.col("value")).alias("mean_length")).withColumn("median_length", _median(hist))


def raw_vs_clean_length(df: DataFrame, raw: str = S.TEXT, cleaned: str = S.CLEANED) -> DataFrame:
    """Mean lengths before and after cleaning."""
    def mean(c: str) -> Column:
        return F.try_divide(F.sum(F.length(c)).cast("double"), F.count(c).cast("double"))

    return df.agg(mean(raw).alias("raw_mean_length"), mean(cleaned).alias("clean_mean_length"))


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin includes the maximum."""
    hist = value_histogram(df, value)
    bounds = hist.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi"))).scalar()
    placed = hist.withColumn("b", bounds)
    lo, hi = F.col("b.lo").cast("double"), F.col("b.hi").cast("double")
    at = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - lo) * bins / (hi - lo)), F.lit(bins - 1))
    )
    return placed.groupBy(at.cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Frequency of every value, most frequent first."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), column)
    return ordered if n is None else ordered.limit(n)


def profile_videos(df: DataFrame) -> DataFrame:
    """Video count, distinct channels, mean views, likes and comments."""
    def mean(c: str) -> Column:
        if c not in df.columns:
            return F.lit(None).cast("double")
        return F.round(F.avg(coerce_numeric(F.col(c))), 2)

    channels = F.count_distinct("channel_name") if "channel_name" in df.columns else F.lit(0)
    return df.agg(
        F.count("*").alias("number_of_videos"), channels.alias("unique_channels"),
        mean("view_count").alias("average_views"), mean("like_count").alias("average_likes"),
        mean("comment_count").alias("average_comments"),
    )


def profile_comments(df: DataFrame, text: str = S.TEXT, digits: int | None = 2) -> DataFrame:
    """Comment count, distinct videos, mean and median length (null text has length 0)."""
    length = F.length(F.coalesce(F.col(text), F.lit("")))
    videos = (
        df.select("video_id").dropna().distinct().agg(F.count("*")).scalar()
        if "video_id" in df.columns else F.lit(0)
    )
    hist = value_counts_of(df, length)
    mean, median = _mean(F.col("value")), _median(hist)
    if digits is not None:
        mean, median = F.round(mean, digits), F.round(median, digits)
    return hist.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_comments"), mean.alias("average_comment_length"),
    ).withColumn("median_comment_length", median).withColumn("unique_videos_represented", videos)


def comments_per_video(df: DataFrame, video: str = "video_id") -> DataFrame:
    """Comments of every video, one row each."""
    return df.filter(F.col(video).isNotNull()).groupBy(video).agg(F.count("*").alias("n"))


def comments_per_video_summary(df: DataFrame, video: str = "video_id", digits: int | None = 2) -> DataFrame:
    """Videos with comments and min, max, mean and median of their counts."""
    sizes = value_counts_of(comments_per_video(df, video), F.col("n"))
    mean, median = _mean(F.col("value")), _median(sizes)
    if digits is not None:
        mean, median = F.round(mean, digits), F.round(median, digits)
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("videos_with_comments"),
        F.coalesce(F.min("value"), F.lit(0)).alias("min_comments_per_video"),
        F.coalesce(F.max("value"), F.lit(0)).alias("max_comments_per_video"),
        mean.alias("average_comments_per_video"),
    ).withColumn("median_comments_per_video", median)


def top_longest(df: DataFrame, key: str = "comment_id", text: str = S.TEXT, n: int = 20) -> DataFrame:
    """The ``n`` longest comments with the available preview columns."""
    preferred = ["comment_id", "video_id", "video_title", text]
    enriched = df.select(
        *[c for c in preferred if c in df.columns], F.length(F.coalesce(F.col(text), F.lit(""))).alias("comment_length")
    )
    return enriched.orderBy(F.desc("comment_length"), key).limit(n)


def top_by(df: DataFrame, measure: str, key: str, columns: list[str], n: int = 20) -> DataFrame:
    """The ``n`` rows with the highest measure."""
    return df.select(*columns).orderBy(F.desc_nulls_last(measure), key).limit(n)


def top_groups(df: DataFrame, group: str, n: int = 20) -> DataFrame:
    return value_counts(df, group, n)


def spam_share(df: DataFrame, flag: str = S.IS_SPAM) -> DataFrame:
    hit = F.count_if(F.col(flag))
    return df.agg((F.try_divide(hit.cast("double"), F.count(flag).cast("double")) * 100).alias("spam_pct"))
