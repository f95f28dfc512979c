"""Language column and its distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from talkmill import schemas as S
from talkmill.functions.binding import with_computed
from talkmill.functions.labels import percent
from talkmill.functions.language import detect_language
from talkmill.functions.text import strip
from talkmill.operators.ranking import first_texts


def add_detected_language(df: DataFrame, text: str = S.TEXT) -> DataFrame:
    if text not in df.columns:
        return df.withColumn(S.LANGUAGE, F.lit("unknown"))
    return with_computed(df, {S.LANGUAGE: detect_language(F.col(text))})


def language_distribution(df: DataFrame, column: str = S.LANGUAGE, digits: int | None = 2) -> DataFrame:
    """Comments and share per language; null counts as unknown."""
    label = F.coalesce(F.col(column), F.lit("unknown")) if column in df.columns else F.lit("unknown")
    counts = df.groupBy(label.alias(column)).agg(F.count("*").alias("n"))
    # The window runs over one row per language label.
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", percent(F.col("n"), total, digits))


def top_examples(df: DataFrame, key: str, text: str = S.TEXT, column: str = S.LANGUAGE, n: int = 5,
                 two_pass: bool = False) -> DataFrame:
    """First ``n`` non-blank trimmed texts per language as (language, rank, text) rows."""
    rows = df.select(
        F.coalesce(F.col(column), F.lit("unknown")).alias(column), F.col(key).alias("_k"), F.col(text).alias("_t")
    ).filter(strip(F.col("_t")) != "")
    found = first_texts(rows, [column], "_k", "_t", n, "example_rank", two_pass)
    return found.select(column, "example_rank", strip(F.col("_t")).alias("example"))
