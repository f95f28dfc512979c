"""Order-based building blocks that survive groups holding a third of all rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

# Up to this n Spark limits groups before the shuffle by itself.
GROUP_LIMIT = 1000


def hash_key(key: Column, seed: int | str) -> Column:
    """Reproducible random order: md5 of ``seed:id``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))))


def first_rows(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of every group in the given order.

    Spark limits each group to ``n`` rows before the shuffle (WindowGroupLimit) as long as n is at
    most GROUP_LIMIT. Beyond, each group is first ranked in the partitions of the input, so its rows
    are spread over as many tasks, and only the first ``n`` of every partition meet.
    """
    name = rank or "_rank"
    if n > GROUP_LIMIT:
        sliced = df.withColumn("_slice", F.spark_partition_id())
        first = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order))
        df = sliced.withColumn("_first", first).filter(F.col("_first") <= n).drop("_slice", "_first")
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def first_texts(df: DataFrame, group: list[str], key: str, text: str, n: int, rank: str, two_pass: bool = False) -> DataFrame:
    """First ``n`` texts per group by key: (group, rank, key, text).

    One pass sorts the texts along with their keys before the limit. ``two_pass`` ranks keys
    alone and then fetches the texts of the chosen ones, which pays off for a stored table
    with wide texts.
    """
    if not two_pass:
        return first_rows(df.select(*group, key, text), group, [F.col(key)], n, rank)
    chosen = first_rows(df.select(*group, key), group, [F.col(key)], n, rank).select(key, rank)
    return df.select(*group, key, text).join(chosen, key)


def rank_by_hash(
    df: DataFrame, group: list[str], key: str, seed: int | str, rank: str = "hash_rank",
    total: str = "group_total", digits: int = 3,
) -> DataFrame:
    """Exact rank of every row within its group in hash order, without one task per group.

    A group is cut into ``16**digits`` slots by the leading hash digits, which keep the
    order. Rows are numbered inside a slot; the slot counts give the offset.
    """
    slot, h = "_slot", "_hash"
    hashed = df.withColumn(h, hash_key(F.col(key), seed)).withColumn(slot, F.substring(h, 1, digits))
    by_group = Window.partitionBy(*group)
    offsets = (
        hashed.groupBy(*group, slot).agg(F.count("*").alias("_n"))
        .withColumn(total, F.sum("_n").over(by_group))
        .withColumn("_before", F.sum("_n").over(by_group.orderBy(slot)) - F.col("_n"))
        .select(*[F.col(c).alias(f"_o_{c}") for c in [*group, slot]], "_before", total)
    )
    inside = Window.partitionBy(*group, slot).orderBy(h, key)
    numbered = hashed.withColumn("_inside", F.row_number().over(inside))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in [*group, slot]))
    return (
        numbered.join(offsets, same)
        .withColumn(rank, F.col("_inside") + F.col("_before"))
        .select(*df.columns, rank, total)
    )


def stack_columns(df: DataFrame, columns: dict[str, str], key: str, value: str, keep: list[str] = ()) -> DataFrame:
    """Turn columns of an aggregate into (key, value) rows; ``columns`` maps column -> key."""
    pairs = F.array(*[
        F.struct(F.lit(label).alias(key), F.col(f"`{name}`").alias(value)) for name, label in columns.items()
    ])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, f"_p.{key}", f"_p.{value}")
