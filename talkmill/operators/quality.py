"""Validation of collected tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talkmill.functions import flags as G
from talkmill.functions.labels import percent
from talkmill.functions.text import strip
from talkmill.operators.ranking import stack_columns


def duplicate_count(df: DataFrame, column: str) -> DataFrame:
    """Rows in groups of a repeated non-null key, number of such keys, and all rows."""
    if column not in df.columns:
        return df.agg(
            F.lit(column).alias("column"), F.lit(False).alias("column_present"),
            F.lit(0).cast("bigint").alias("duplicate_rows"), F.lit(0).cast("bigint").alias("duplicate_values"),
            F.count("*").alias("total_rows"),
        )
    n, repeated = F.col("n"), (F.col("n") > 1) & F.col("k").isNotNull()
    return df.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n")).agg(
        F.lit(column).alias("column"),
        F.lit(True).alias("column_present"),
        F.coalesce(F.sum(F.when(repeated, n)), F.lit(0)).alias("duplicate_rows"),
        F.count_if(repeated).alias("duplicate_values"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_rows"),
    )


def missing_by_column(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Null count and share per column, in one pass."""
    counted = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_m_{c}") for c in df.columns]
    )
    rows = stack_columns(counted, {f"_m_{c}": c for c in df.columns}, "column", "missing_count", ["_rows"])
    return rows.select(
        "column", "missing_count", percent(F.col("missing_count"), F.col("_rows"), digits).alias("missing_percentage")
    )


def missing_sorted(df: DataFrame) -> DataFrame:
    """Columns that have nulls, most nulls first."""
    return (
        missing_by_column(df).filter("missing_count > 0").select("column", "missing_count")
        .orderBy(F.desc("missing_count"), "column")
    )


def missing_cells(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Null cells, all cells and their share."""
    nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0).cast("bigint"))
    counted = df.agg(nulls.alias("missing_cells"), (F.count("*") * len(df.columns)).alias("all_cells"))
    return counted.withColumn(
        "percentage_missing_values", percent(F.col("missing_cells"), F.col("all_cells"), digits)
    )


def _text_quality(c: Column, minimum: int = 3) -> dict[str, Column]:
    text = F.coalesce(c, F.lit(""))
    return {
        "empty_comments": F.count_if(text == ""),
        "whitespace_only_comments": F.count_if((text != "") & (strip(text) == "")),
        "comments_shorter_than_3_characters": F.count_if(F.length(strip(text)) < minimum),
    }


def text_quality_counts(df: DataFrame, column: str = "comment_text") -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in _text_quality(F.col(column)).items()])


def invalid_url_count(df: DataFrame, column: str = "video_url") -> DataFrame:
    present = column in df.columns
    count = F.count_if(G.is_invalid_url(F.col(column))) if present else F.lit(0).cast("bigint")
    return df.agg(F.lit(column).alias("column"), F.lit(present).alias("column_present"), count.alias("invalid_count"))


def invalid_timestamps(df: DataFrame, columns: list[str]) -> DataFrame:
    """Unparsable non-null values per timestamp column."""
    known = {c: c in df.columns for c in columns}
    counted = df.agg(*[
        (F.count_if(G.is_invalid_timestamp(F.col(c))) if known[c] else F.lit(0).cast("bigint")).alias(c)
        for c in columns
    ])
    rows = stack_columns(counted, {c: c for c in columns}, "column", "invalid_count")
    present = F.col("column").isin([c for c, there in known.items() if there])
    return rows.withColumn("column_present", present)


def _validation(df: DataFrame, key: str, extra: dict[str, Column], timestamps: list[str]) -> DataFrame:
    """Long report (metric, key, value): one scan for the counts and one grouping for the key."""
    metrics: dict[tuple[str, str], Column] = {("total_rows", ""): F.count("*")}
    for c in df.columns:
        metrics["missing_count", c] = F.count_if(F.col(f"`{c}`").isNull())
    metrics.update({(name, ""): c for name, c in extra.items()})
    for c in timestamps:
        metrics["invalid_timestamps", c] = (
            F.count_if(G.is_invalid_timestamp(F.col(c))) if c in df.columns else F.lit(0).cast("bigint")
        )
    counted = df.agg(*[c.cast("double").alias(f"_{i}") for i, c in enumerate(metrics.values())])
    entries = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(k).alias("key"), F.col(f"_{i}").alias("value"))
        for i, (m, k) in enumerate(metrics)
    ])
    total = F.col("_0")
    missing = sum((F.col(f"_{i}") for i, (m, _) in enumerate(metrics) if m == "missing_count"), F.lit(0.0))
    shares = [F.struct(
        F.lit("percentage_missing_values").alias("metric"), F.lit("").alias("key"),
        percent(missing, total * len(df.columns)).alias("value"),
    )]
    for name, label in (("empty_comments", "percentage_empty_comments"),
                        ("comments_shorter_than_3_characters", "percentage_very_short_comments")):
        if name in extra:
            at = list(metrics).index((name, ""))
            shares.append(F.struct(
                F.lit(label).alias("metric"), F.lit("").alias("key"), percent(F.col(f"_{at}"), total).alias("value"),
            ))
    long = counted.select(F.explode(F.concat(entries, F.array(*shares))).alias("e")).select("e.*")
    dup = duplicate_count(df, key).select(
        F.col("duplicate_rows").cast("double").alias("duplicate_rows"),
        F.col("duplicate_values").cast("double").alias("duplicate_values"),
        percent(F.col("duplicate_rows"), F.col("total_rows")).alias("percentage_duplicates"),
    )
    dup_rows = stack_columns(dup, {c: c for c in dup.columns}, "metric", "value")
    return long.unionByName(dup_rows.withColumn("key", F.lit(key)))


def validate_videos(df: DataFrame) -> DataFrame:
    """Identity, completeness, URL and timestamp quality of a video table."""
    url = F.count_if(G.is_invalid_url(F.col("video_url"))) if "video_url" in df.columns else F.lit(0)
    return _validation(df, "video_id", {"invalid_urls": url}, ["published_at"])


def validate_comments(df: DataFrame) -> DataFrame:
    """Identity, completeness, text and timestamp quality of a comment table."""
    text = (
        _text_quality(F.col("comment_text")) if "comment_text" in df.columns
        else dict.fromkeys(_text_quality(F.lit("")), F.lit(0))
    )
    return _validation(df, "comment_id", text, ["published_at", "updated_at"])
