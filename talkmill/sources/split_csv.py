"""CSV files with quoted line breaks, read by many tasks at once.

Where a file is cut, a task cannot know whether its first line lies inside a quoted field. So
every cut piece is first followed from both states, outside and inside quotes, which takes one
light pass and leaves two numbers a piece. Composed in file order these say how each piece really
starts. Then the pieces are read for good: whole records leave a task as they are, and only what
hangs over an edge is put together from its fragments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

BOM = "﻿"
#: Pieces up to which their starting states are sent to all executors, about 30 bytes each.
FEW_PIECES = 1_000_000

_OPTIONS = {"escape": '"', "multiLine": "true"}
_PIECES = "file long, block long, from_out boolean, from_in boolean"
_RECORDS = "file long, block long, first boolean, opens boolean, closes boolean, text string"
_NAMES = ["file", "block", "first", "opens", "closes", "text"]
_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
#: What ends the unquoted stretch of a line: a field that begins with a quote.
_OPENING = re.compile('(?:^|,)"')
#: Inside quotes: a quote that is not doubled.
_CLOSING = re.compile('(?:[^"]|"")*"(?!")')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that starts inside or outside quotes ends inside them.

    A quote opens a field only at its start, as the CSV reader has it, and is doubled inside.
    """
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            closing = _CLOSING.match(line, at)
            if closing is None:
                return True
            at, inside = closing.end(), False
        else:
            # After a closing quote, or in an unquoted field, only a separator leads to the next field.
            opening = _OPENING.search(line, at) if at else _OPENING.match(line) or _OPENING.search(line)
            if opening is None or (at and opening.start() < at):
                return False
            at, inside = opening.end(), True


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, value): lines in the order they are read, with a number for the file and the piece they lie in."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _unmarked(line: str, block: int, first: bool) -> str:
    return line[1:] if first and block == 0 and line.startswith(BOM) else line


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines to one row per piece: the state at its end for either state at its start."""
    def row(piece: tuple[int, int], out: bool, in_: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*piece, out, in_), (pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))],
                                          names=["file", "block", "from_out", "from_in"])

    own, out, in_ = None, False, True
    for batch in batches:
        for file, block, line in zip(*(c.to_pylist() for c in batch.columns)):
            first = (file, block) != own
            if first:
                if own is not None:
                    yield row(own, out, in_)
                own, out, in_ = (file, block), False, True
            line = _unmarked(line, block, first)
            out, in_ = ends_inside(line, out), ends_inside(line, in_)
    if own is not None:
        yield row(own, out, in_)


def piece_states(lines: DataFrame) -> DataFrame:
    """(file, block, inside): whether a piece starts inside quotes.

    What a piece does to the state is one of: set it, keep it, turn it around. So the state after
    any number of pieces is the last one set, turned as often as pieces since then turn it.
    """
    pieces = lines.mapInArrow(_follow, _PIECES)
    sets, turns = F.col("from_out") == F.col("from_in"), F.col("from_out") & ~F.col("from_in")
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = pieces.withColumn("_turns", F.sum(turns.cast("int")).over(upto))
    last = F.last(F.when(sets, F.struct(F.col("from_out").alias("state"), F.col("_turns").alias("turns"))), ignorenulls=True)
    # Of the pieces before this one; a file starts outside.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = turned.withColumns({"_last": last.over(before), "_n": F.coalesce(F.lag("_turns").over(Window.partitionBy("file").orderBy("block")), F.lit(0))})
    odd = (F.col("_n") - F.coalesce(F.col("_last.turns"), F.lit(0))) % 2 == 1
    return known.select("file", "block", (F.coalesce(F.col("_last.state"), F.lit(False)) != odd).alias("inside"))


def _records(fragments: bool):
    """Lines with the state of their piece to whole records, or to the fragments at the edges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, began, inside, first = None, [], False, False, False
        rows: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)
                rows.clear()

        def end_of_piece() -> None:
            if held and fragments:
                rows.append((*own, first, began, False, "\n".join(held)))
            held.clear()

        for batch in batches:
            for file, block, line, start in zip(*(c.to_pylist() for c in batch.columns)):
                new = (file, block) != own
                if new:
                    end_of_piece()
                    # A piece that starts inside quotes goes on with a record of the piece before.
                    own, inside, began, first = (file, block), start, not start, block == 0
                line = _unmarked(line, block, new)
                held.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    # Whole records began here; a record that began in an earlier piece is a fragment that closes.
                    if began != fragments:
                        rows.append((file, block, first, began, True, "\n".join(held)))
                    held.clear()
                    began, first = True, False
            yield from flush()
        end_of_piece()
        yield from flush()

    return run


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(text) of every record after the headers: whole, also where a file was cut inside it."""
    lines = lines_of(spark, path)
    states = piece_states(lines).cache()
    few = states.count() <= FEW_PIECES
    edges = Window.partitionBy("file").orderBy("block")
    # Pieces with an edge inside a record: they start there, or the next one does.
    cut = states.withColumn("_next", F.lead("inside").over(edges)).where("inside OR _next").select("file", "block", "inside")

    def pieces(wanted: DataFrame, how: str) -> DataFrame:
        small = wanted.select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.col("inside").alias("_in"))
        joined = lines.join(F.broadcast(small) if few else small, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")), how)
        # The layout of the second reading must be that of the first.
        changed = F.raise_error(F.lit("the files were cut differently while they were read"))
        start = F.coalesce("_in", changed.cast("boolean")) if how == "left" else F.col("_in")
        return joined.select("file", "block", "value", start.alias("start"))

    whole = pieces(states, "left").mapInArrow(_records(False), _RECORDS).where("NOT first").select("text")
    parts = pieces(cut, "inner").mapInArrow(_records(True), _RECORDS)
    # A fragment that opens starts a record; those behind it belong to it.
    number = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("file").orderBy("block", F.col("opens").cast("int")))
    joined = parts.withColumn("_record", number).groupBy("file", "_record").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "\n").alias("text"), F.max("first").alias("first"))
    records = whole.unionByName(joined.where("NOT first").select("text"))
    # Lines may end in \r\n; empty lines are no records.
    return records.select(F.regexp_replace("text", "\r$", "").alias("text")).where("text <> ''")


def header(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Column names from the first record of a file."""
    names = spark.read.option("header", True).options(**_OPTIONS).csv(path).columns
    return [n.lstrip(BOM) for n in names]


def parsed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Records as columns, by position."""
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    return records.select(F.from_csv("text", ddl, _OPTIONS).alias("r")).select("r.*")


#: Types tried in this order on columns without a given type, with the shape their values have.
SHAPES = [
    ("int", r"^[+-]?\d{1,10}$"), ("bigint", r"^[+-]?\d{1,19}$"), ("double", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"),
    ("date", r"^\d{4}-\d{2}-\d{2}$"), ("timestamp", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"), ("boolean", "(?i)^(true|false)$"),
]


def fits(c: Column, kind: str, shape: str) -> Column:
    """Whether a value, where there is one, can be read as a type."""
    return c.isNull() | (c.rlike(shape) & c.try_cast(kind).isNotNull())


def type_tests(columns: list[str]) -> list[Column]:
    """One aggregate per column and type: all values fit. For use with ``observe``."""
    return [F.coalesce(F.bool_and(fits(F.col(f"`{c}`"), kind, shape)), F.lit(True)).alias(f"{i}_{kind}") for i, c in enumerate(columns) for kind, shape in SHAPES] + [
        F.count(F.col(f"`{c}`")).alias(f"{i}_n") for i, c in enumerate(columns)]


def found_types(columns: list[str], tests: dict) -> list[str]:
    """The first type that all values of a column fit; text for columns without a value."""
    return [next((kind for kind, _ in SHAPES if tests[f"{i}_n"] and tests[f"{i}_{kind}"]), "string") for i in range(len(columns))]
