"""Bind an expression once and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A plain alias may be inlined into every use, also into lambdas that run per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def with_computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` for expensive expressions that later filters refer to.

    A filter on a plain computed column is pushed below the projection, where the expression
    (and any Python step in it) is evaluated again. It is not pushed below a generator, so
    the columns come out of a one-row ``inline`` and exist once.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(row)))
