"""Whole results of jobs as (report, key, name, value) rows, in Spark and in SQL.

Values are text; floating numbers have six digits behind the point.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from talkmill.checks.bindings import lit

_FLOATING = (T.FloatType, T.DoubleType)


def _text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, _FLOATING):
        # Adding zero takes the sign from a negative zero.
        return (F.round(c.cast("double"), 6) + F.lit(0.0)).cast("decimal(28,6)").cast("string")
    return c.cast("string")


def facts(df: DataFrame, report: str, keys: list[str] = (), columns: list[str] | None = None) -> DataFrame:
    """One row per row and column of a table; keys are joined by a bar."""
    shown = [c for c in (columns or df.columns) if c not in keys]
    values = F.array(*[F.struct(F.lit(c).alias("name"), _text(F.col(f"`{c}`"), df.schema[c].dataType).alias("value")) for c in shown])
    key = F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys]) if keys else F.lit("")
    return df.select(F.lit(report).alias("report"), key.alias("key"), F.inline(values))


def all_facts(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [facts(df, name, keys) for name, (df, keys) in tables.items()])


def sql_facts(report: str, source: str, key: str, columns: dict[str, str], floating: tuple[str, ...] = ()) -> str:
    """The same rows of a SQL table; ``columns`` maps names to expressions."""
    def value(name: str, expression: str) -> str:
        return f"CAST(CAST(round(CAST({expression} AS DOUBLE), 6) + 0.0 AS DECIMAL(28,6)) AS VARCHAR)" if name in floating else f"CAST({expression} AS VARCHAR)"

    return " UNION ALL ".join(f"SELECT {lit(report)} AS report, {key} AS key, {lit(n)} AS name, {value(n, e)} AS value FROM {source}" for n, e in columns.items())


def row_facts(df: DataFrame, report: str, columns: list[str]) -> DataFrame:
    """Tables without a key: one row per row, its values joined by bars."""
    value = F.concat_ws("|", *[F.coalesce(_text(F.col(f"`{c}`"), df.schema[c].dataType), F.lit("-")) for c in columns])
    return df.select(F.lit(report).alias("report"), F.lit("").alias("key"), F.lit("row").alias("name"), value.alias("value"))


def sql_row_facts(report: str, source: str, expressions: list[str]) -> str:
    value = "concat_ws('|', " + ", ".join(f"coalesce(CAST({e} AS VARCHAR), '-')" for e in expressions) + ")"
    return f"SELECT {lit(report)} AS report, '' AS key, 'row' AS name, {value} AS value FROM {source}"
