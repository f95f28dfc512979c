"""Running totals and exact quantiles of columns with any number of distinct values.

Distinct values with their counts are dealt into ranges by boundaries taken from a sketch. Totals
are summed inside a range and moved up by the ranges before it, so no task holds the column; the
boundaries only decide how even the ranges are, never the result.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from talkmill.session import checkpointing

#: Distinct values a range holds, about, and the most ranges.
RANGE_ROWS, MOST_RANGES = 200_000, 4096


def value_counts_of(df: DataFrame, value: Column) -> DataFrame:
    """(value, n) per distinct non-null value, written once: quantiles read it several times."""
    checkpointing(df.sparkSession)
    return df.select(value.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")).checkpoint()


def boundaries(counts: DataFrame) -> list:
    """Values that cut the distinct values into ranges of about equal size."""
    rows = counts.count()
    ranges = min(MOST_RANGES, -(-rows // RANGE_ROWS))
    if ranges <= 1:
        return []
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    return sorted(set(counts.agg(F.percentile_approx("value", shares, F.lit(10 * ranges)).alias("b")).first()["b"]))


def with_running_totals(counts: DataFrame) -> DataFrame:
    """Adds ``upto``: rows with this value or a smaller one, and ``total``."""
    bounds = boundaries(counts)

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return values.map(lambda v: bisect_left(bounds, v)).astype("int32")

    ranged = counts.withColumn("_range", place(F.col("value")) if bounds else F.lit(0))
    sizes = ranged.groupBy("_range").agg(F.sum("n").alias("_n"))
    every = Window.partitionBy()  # one row a range
    before = sizes.select(
        F.col("_range").alias("_r"), (F.sum("_n").over(every.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"), F.sum("_n").over(every).alias("total"))
    inside = F.sum("n").over(Window.partitionBy("_range").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.withColumn("_inside", inside).join(before, F.col("_range") == F.col("_r")).select(*counts.columns, (F.col("_inside") + F.col("_before")).alias("upto"), "total")


def value_at(rank: Column) -> Column:
    """Aggregate over running totals: the value at a rank counted from 0."""
    return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("value")))


def quantile(share: float) -> Column:
    """Aggregate over running totals: the quantile, interpolated between the two values around its place."""
    place = (F.col("total") - 1) * F.lit(float(share))
    low, high = F.floor(place), F.ceil(place)
    lower, upper = value_at(low).cast("double"), value_at(high).cast("double")
    above = F.max(place - low)
    return F.when(above == 0, lower).otherwise((F.lit(1.0) - above) * lower + above * upper)


def quantiles(counts: DataFrame, shares: list[float]) -> DataFrame:
    """One row with an array of quantiles; null for a column without values."""
    return with_running_totals(counts).agg(F.array(*[quantile(s) for s in shares]).alias("q"))
