"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from talkmill.session import run_dir

#: The white space of all word splits: bytes.split() and bytes.translate() agree with it.
BLANKS = b" \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def by_value(module: str) -> None:
    """Send the functions of a module to the executors by value, so they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table once to the shared folder and read it back.

    Cuts the lineage: an executor lost later costs the tasks it ran, not this table.
    """
    path = run_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def same(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality of two lists of columns."""
    return reduce(and_, (a.eqNullSafe(b) for a, b in zip(left, right, strict=True)))


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``taken`` clashes."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = f"_{wanted}"
    return wanted


def numbered(df: DataFrame, group: str, cell: str, order: list[str], number: str) -> DataFrame:
    """Gapless number from 0 of every row within ``group``, ordered by cell, then by ``order``.

    Rows are numbered inside (group, cell) and moved up by the sizes of the cells before, so a
    group that holds most rows is spread over as many tasks as it has cells. The table is read
    twice: pass a staged one.
    """
    sizes = df.groupBy(group, cell).agg(F.count("*").alias("_n"))
    before = sizes.select(
        F.col(group).alias("_g"), F.col(cell).alias("_c"),
        (F.sum("_n").over(Window.partitionBy(group).orderBy(cell)) - F.col("_n")).alias("_before"),
    )
    inside = F.row_number().over(Window.partitionBy(group, cell).orderBy(*order)) - 1
    return (
        df.withColumn("_inside", inside)
        .join(before, same([F.col(group), F.col(cell)], [F.col("_g"), F.col("_c")]))
        .withColumn(number, (F.col("_inside") + F.col("_before")).cast("long"))
        .drop("_inside", "_before", "_g", "_c")
    )


def cells_for(rows: int, groups: int, per_cell: int = 50_000, least: int = 256) -> int:
    """Cells a group is cut into, so that a cell keeps about ``per_cell`` rows at any size."""
    return max(least, -(-rows // (max(1, groups) * per_cell)))


#: Bytes of a piece of a fixed table.
PIECE = 1 << 16


def pieces_of(table: np.ndarray, names: list[str], pad: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """A table as (piece, content) rows without its empty pieces; other columns are null."""
    raw = table.tobytes()
    rows = [(i, raw[i * PIECE:(i + 1) * PIECE]) for i in range(-(-len(raw) // PIECE))]
    rows = [r for r in rows if any(r[1])]
    if rows:
        columns = {"piece": pa.array([r[0] for r in rows], pa.int32()), "content": pa.array([r[1] for r in rows], pa.binary())}
        yield pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(len(rows), pad.get(c))) for c in names], names=names)


def combined(pieces: DataFrame, dtype, join: np.ufunc, size: int) -> np.ndarray:
    """Sum or union of the pieces of all tasks: a table of fixed size for the driver."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(content, dtype)
                held[piece] = join(held[piece], own) if piece in held else own
        for piece, content in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([content.tobytes()], pa.binary())], names=["piece", "content"])

    folded = pieces.select("piece", "content").mapInArrow(fold, "piece int, content binary")
    whole = np.zeros(size, dtype)
    per = PIECE // whole.itemsize
    for r in folded.repartition("piece").mapInArrow(fold, "piece int, content binary").collect():
        own = np.frombuffer(r["content"], dtype)
        whole[r["piece"] * per:r["piece"] * per + len(own)] = own
    return whole
