"""Duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talkmill.operators.ranking import first_rows


def keep_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order; all null keys count as one key."""
    return first_rows(df, [key], order, 1) if key in df.columns else df


def removed_count(df: DataFrame, key: str) -> DataFrame:
    """How many rows :func:`keep_first` drops (one row, column ``removed``)."""
    if key not in df.columns:
        return df.limit(1).agg(F.lit(0).cast("bigint").alias("removed"))
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"))
