"""Parquet files whose columns differ in type, read as one table without losing a value.

Writers do not agree on types: a nullable whole-number column arrives as double from one and as
bigint from another, and a column that is null throughout has no type of its own. Files whose
schemas merge form a class; a class is read in one scan with its own schema, its columns are cast
to the common type, and the classes are put together by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

INTEGRAL = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
_DIGITS = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 19}
_WRITE_JOB = re.compile(r"part-\d+-([0-9a-f-]{36})")


class NoCommonType(TypeError):
    """Two types of one column have no type that holds the values of both."""


def _decimal(a: T.DataType) -> T.DecimalType:
    return a if isinstance(a, T.DecimalType) else T.DecimalType(_DIGITS[a], 0)


def _is_number(a: T.DataType) -> bool:
    return isinstance(a, T.NumericType)


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds the values of both; the null type gives way to any other.

    Whole numbers take the wider type; with floating ones they become double, which
    :func:`conform` refuses for a value that double does not hold. Numbers, dates and truth values
    next to text become text. Structs join their fields, arrays and maps their content.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if a in INTEGRAL and b in INTEGRAL:
        return INTEGRAL[max(INTEGRAL.index(a), INTEGRAL.index(b))]
    if _is_number(a) and _is_number(b):
        if isinstance(a, (T.FloatType, T.DoubleType)) or isinstance(b, (T.FloatType, T.DoubleType)):
            return T.DoubleType()
        x, y = _decimal(a), _decimal(b)
        scale = max(x.scale, y.scale)
        whole = max(x.precision - x.scale, y.precision - y.scale)
        if whole + scale > 38:
            raise NoCommonType(f"{a.simpleString()} and {b.simpleString()} need more than 38 digits")
        return T.DecimalType(whole + scale, scale)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return joined_fields([a, b])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType), a.containsNull or b.containsNull)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(common_type(a.keyType, b.keyType), common_type(a.valueType, b.valueType), a.valueContainsNull or b.valueContainsNull)
    times = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if isinstance(a, times) and isinstance(b, times):
        return max(a, b, key=lambda t: times.index(type(t)))
    atomic = (T.NumericType, T.BooleanType, T.StringType, *times)
    if isinstance(a, atomic) and isinstance(b, atomic):
        return T.StringType()
    raise NoCommonType(f"{a.simpleString()} and {b.simpleString()} have no common type")


def joined_fields(schemas: list[T.StructType]) -> T.StructType:
    """All fields by name in order of appearance, each with its common type, nullable."""
    types: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            try:
                types[f.name] = common_type(types[f.name], f.dataType) if f.name in types else f.dataType
            except NoCommonType as error:
                raise NoCommonType(f"column {f.name}: {error}") from None
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


def _agree(a: T.StructType, b: T.StructType) -> bool:
    have = {f.name: f.dataType.simpleString() for f in a.fields}
    return all(have.get(f.name, f.dataType.simpleString()) == f.dataType.simpleString() for f in b.fields)


def conform(c: Column, have: T.DataType, want: T.DataType, name: str = "value") -> Column:
    """A column in another type; a value that the type does not hold stops the job instead of changing."""
    if have == want:
        return c
    if isinstance(have, T.NullType):
        return F.lit(None).cast(want)
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        own = {f.name: f.dataType for f in have.fields}
        fields = [(conform(c[f.name], own[f.name], f.dataType, f"{name}.{f.name}") if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(c, lambda x: conform(x, have.elementType, want.elementType, name))
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):
        return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(
            conform(e["key"], have.keyType, want.keyType, name), conform(e["value"], have.valueType, want.valueType, name))))
    cast = c.try_cast(want)
    if isinstance(want, T.StringType):
        return cast
    holds = cast.isNotNull()
    if not isinstance(have, T.StringType):
        # There and back: 2^53 + 1 as double, 1.5 as bigint or a time of day as date do not return.
        holds = holds & cast.try_cast(have).eqNullSafe(c)
    problem = F.concat(F.lit(f"column {name}: {want.simpleString()} does not hold "), c.cast("string"))
    return F.when(c.isNull() | holds, cast).otherwise(F.raise_error(problem).cast(want))


@dataclass
class FileClass:
    """Files whose schemas merge, the merged schema, and its columns that hold nothing but nulls."""

    paths: list[str]
    schema: T.StructType
    empty: set[str] = field(default_factory=set)

    def types(self) -> T.StructType:
        """The schema with the null type for empty columns."""
        return T.StructType([T.StructField(f.name, T.NullType() if f.name in self.empty else f.dataType) for f in self.schema.fields])


def escaped(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _reader(spark: SparkSession, base: str | None):
    return spark.read if base is None else spark.read.option("basePath", base)


def cannot_merge(error: Exception) -> bool:
    """Whether Spark refused to merge the schemas of files."""
    if isinstance(error, Py4JJavaError):
        return "CANNOT_MERGE_SCHEMAS" in str(error.java_exception)
    return isinstance(error, PySparkException) and (error.getCondition() or "").startswith("CANNOT_MERGE")


def merged_schema(spark: SparkSession, paths: list[str], base: str | None = None) -> T.StructType | None:
    """Schema of all files together, from their footers, which Spark reads in parallel; None where types clash."""
    try:
        return _reader(spark, base).option("mergeSchema", "true").parquet(*map(escaped, paths)).schema
    except (Py4JJavaError, PySparkException) as error:
        if cannot_merge(error):
            return None
        raise


def _by_writer(path: str) -> tuple[str, str, str]:
    """Sort key that brings the files of one write job together: they agree in types."""
    folder, _, name = path.rpartition("/")
    job = _WRITE_JOB.match(name)
    return folder, job.group(1) if job else "", name


def file_classes(spark: SparkSession, paths: list[str], base: str | None = None, at_once: int = 8) -> list[FileClass]:
    """Classes of files that merge.

    Lists of neighbouring files that do not merge are halved until they do, so two classes in a
    few runs cost a handful of footer jobs; classes that agree are put together again.
    """
    pending, found = [sorted(paths, key=_by_writer)], []
    with ThreadPoolExecutor(at_once) as pool:
        while pending:
            schemas = list(pool.map(lambda p: merged_schema(spark, p, base), pending))
            halves = []
            for part, schema in zip(pending, schemas):
                if schema is not None:
                    found.append((part, schema))
                else:
                    middle = len(part) // 2
                    halves += [part[:middle], part[middle:]]
            pending = halves
    classes: list[FileClass] = []
    for part, schema in sorted(found, key=lambda f: _by_writer(f[0][0])):
        own = next((c for c in classes if _agree(c.schema, schema)), None)
        if own is None:
            classes.append(FileClass(part, schema))
        else:
            own.paths += part
            own.schema = joined_fields([own.schema, schema])
    return classes


def read_class(spark: SparkSession, own: FileClass, base: str | None = None) -> DataFrame:
    return _reader(spark, base).schema(own.schema).parquet(*map(escaped, own.paths))


def find_empty_columns(spark: SparkSession, classes: list[FileClass], base: str | None = None) -> None:
    """Mark columns without a value where their type would decide against the other classes.

    Asked only for columns whose types are not all numbers. The test for a value is pushed to the
    files, which skip row groups that their statistics show to be null.
    """
    types: dict[str, list[T.DataType]] = {}
    for own in classes:
        for f in own.schema.fields:
            types.setdefault(f.name, []).append(f.dataType)
    for name, kinds in types.items():
        if len({k.simpleString() for k in kinds}) == 1 or all(map(_is_number, kinds)):
            continue
        for own in classes:
            if name in own.schema.names and read_class(spark, own, base).where(F.col(f"`{name}`").isNotNull()).select(F.lit(1)).isEmpty():
                own.empty.add(name)


def read_mixed(
    spark: SparkSession, paths: list[str], schema: T.StructType | None = None, base: str | None = None,
    extra: Callable[[DataFrame], list[Column]] = lambda df: [],
) -> DataFrame:
    """Files of any types as one table: one scan per class, columns cast, missing ones null.

    Without ``schema`` the columns are those of all files with their common types. ``extra`` gives
    further columns of each scan, such as file metadata.
    """
    classes = file_classes(spark, paths, base)
    find_empty_columns(spark, classes, base)
    wanted = joined_fields([c.types() for c in classes]) if schema is None else schema
    # A column that is null in every class keeps the type the first file gives it.
    first = {f.name: f.dataType for c in reversed(classes) for f in c.schema.fields}
    wanted = T.StructType([T.StructField(f.name, first[f.name] if isinstance(f.dataType, T.NullType) else f.dataType) for f in wanted.fields])
    tables = []
    for own in classes:
        df, types = read_class(spark, own, base), {f.name: f.dataType for f in own.types().fields}
        columns = [
            (conform(F.col(f"`{f.name}`"), types[f.name], f.dataType, f.name) if f.name in types else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in wanted.fields
        ]
        tables.append(df.select(*columns, *extra(df)))
    return reduce(DataFrame.unionByName, tables)
