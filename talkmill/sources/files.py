"""Parquet, CSV and JSON sources and sinks."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from talkmill.session import run_dir
from talkmill.sources import split_csv
from talkmill.sources.mixed import cannot_merge, escaped, read_mixed

BOM = "\ufeff"


def scan_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


# What Spark says of a folder that is missing or has no matching file; other errors are raised.
NOTHING_THERE = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def nothing_there(error: AnalysisException) -> bool:
    return error.getCondition() in NOTHING_THERE


def _empty(spark: SparkSession, schema: T.StructType | None) -> DataFrame:
    return spark.createDataFrame([], schema or T.StructType([]))


def scan_parquet_glob(spark: SparkSession, directory: str, pattern: str, schema: T.StructType | None = None,
                      provenance: bool = False) -> DataFrame:
    """All files of a folder that match a pattern as one table, missing columns null.

    A folder in it whose name matches is a table written in parts: its files belong to it.
    Files may differ in the types of their columns: these get a common type, or that of ``schema``,
    and a value it does not hold stops the job. A missing folder or no match gives an empty table.
    ``provenance`` adds the file and the row position in it, which makes "first copy" well defined.
    """
    matching = spark.read.option("pathGlobFilter", pattern)
    origin = [F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.row_index").alias("source_row")] if provenance else []
    own, tables = list_files(spark, directory, pattern), list_files(spark, f"{directory}/{pattern}", "*").select("path")
    where = [directory]
    if not tables.join(own, "path", "left_anti").isEmpty():
        # What lies in partition folders matches file by file only.
        where = [f"{directory}/{pattern}", *sorted(escaped(r["path"]) for r in own.join(tables, "path", "left_anti").collect())]
        matching = spark.read
    try:
        df = matching.option("mergeSchema", "true").parquet(*where)
        merges = schema is None or all(df.schema[f.name].dataType == f.dataType for f in schema.fields if f.name in df.columns)
    except AnalysisException as error:
        if not nothing_there(error):
            raise
        df = _empty(spark, schema)
        extra = {"source_file": F.lit("").cast("string"), "source_row": F.lit(0).cast("bigint")}
        return df.withColumns(extra) if provenance else df
    except Py4JJavaError as error:
        if not cannot_merge(error):
            raise
        merges = False
    if merges:
        if schema is not None:
            df = matching.schema(schema).parquet(*where)
        return df.select("*", *origin)
    paths = [r["path"] for r in own.select("path").union(tables).distinct().collect()]
    base = None if any(c in directory for c in "*?[{") else directory
    return read_mixed(spark, paths, schema, base, lambda scan: origin)


def list_files(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """(path, modified, bytes) of matching files; only the listing is read, no content."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    except AnalysisException as error:
        if not nothing_there(error):
            raise
        return _empty(spark, T.StructType([
            T.StructField("path", T.StringType()), T.StructField("modified", T.TimestampType()),
            T.StructField("bytes", T.LongType()),
        ]))
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def latest_file(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """The most recently modified matching file (one row)."""
    newest = F.max_by("path", F.struct("modified", "path"))
    return list_files(spark, directory, pattern).agg(newest.alias("path"), F.max("modified").alias("modified"))


def latest_dataset(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """The most recently written table; reads the listing first.

    Part files belong to the folder they lie in, so a table of several parts is read whole. Files
    that are no part of a written table (``part-*``) are tables of their own.
    """
    parent, name = F.regexp_replace("path", "/[^/]*$", ""), F.element_at(F.split("path", "/"), -1)
    root = F.when(name.startswith("part-"), parent).otherwise(F.col("path"))
    newest = list_files(spark, directory, pattern).agg(F.max_by(root, F.struct("modified", "path")).alias("root")).first()["root"]
    if newest is None:
        raise FileNotFoundError(f"no file matches {pattern} in {directory}")
    return spark.read.parquet(newest)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with header; quoted fields may span lines and contain quotes.

    Large files are read by many tasks: see :mod:`talkmill.sources.split_csv`. Without a schema the
    types are found while the parsed text is written to the shared folder once; what follows
    reads that table.
    """
    records, names = split_csv.csv_records(spark, path), split_csv.header(spark, path)
    if schema is not None:
        return split_csv.parsed(records, schema)
    plain = split_csv.parsed(records, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    seen, at = Observation("csv types"), run_dir(spark, "csv")
    plain.observe(seen, *split_csv.type_tests(names)).write.parquet(at)
    kinds = split_csv.found_types(names, seen.get)
    return spark.read.schema(plain.schema).parquet(at).select(*[F.col(f"`{n}`").cast(k).alias(n) for n, k in zip(names, kinds)])


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header; every part file starts with the UTF-8 byte order mark."""
    first = df.columns[0]
    marked = df.withColumnRenamed(first, BOM + first)
    writer = marked.write.mode(mode).option("header", True).option("escape", '"').option("encoding", "UTF-8")
    # The writer would trim every value by default.
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_report_json(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report as JSON lines in one file; reports are small aggregates.

    The shuffle before the write keeps the tasks that make the report.
    """
    report.repartition(1).write.mode(mode).json(path)


def table_shape(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type and the table's row count."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    columns = df.sparkSession.createDataFrame(rows, "position int, column string, type string")
    return columns.withColumn("rows", df.agg(F.count("*")).scalar())


def skip_processed(incoming: DataFrame, processed: DataFrame, slug: str = "product_slug") -> DataFrame:
    """Incoming products that have no processed partition yet."""
    return incoming.join(processed.select(slug).distinct(), slug, "left_anti")


def dictionary_table(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary of any size: a CSV table (source, english) of words and phrases."""
    return scan_csv(spark, path, T._parse_datatype_string("source string, english string"))


def load_dictionary(spark: SparkSession, path: str, max_entries: int = 500_000) -> dict[str, str]:
    """A dictionary table as a dict for the column functions; its size is checked before it is collected."""
    rows = dictionary_table(spark, path).limit(max_entries + 1).collect()
    if len(rows) > max_entries:
        raise ValueError(f"dictionary has more than {max_entries} entries: pass dictionary_table() instead")
    return {r["source"]: r["english"] for r in rows}


def file_order(df: DataFrame) -> list[Column]:
    """Sort keys of the original file order (see ``provenance``)."""
    return [F.col(c) for c in ("source_file", "source_row") if c in df.columns]
