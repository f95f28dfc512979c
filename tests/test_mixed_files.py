"""Files of different types read as one table."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from talkmill.sources import files
from talkmill.sources.mixed import NoCommonType, common_type, file_classes


def put(folder, name, **columns):
    pq.write_table(pa.table(columns), str(folder / name))


def rows(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: r["id"])


def test_long_double_null_and_missing(spark, tmp_path):
    put(tmp_path, "a.parquet", id=[1, 2], like_count=pa.array([5, None], pa.int64()), title=["x", "y"])
    put(tmp_path, "b.parquet", id=[3, 4], like_count=pa.array([7.0, None], pa.float64()), title=pa.nulls(2))
    put(tmp_path, "c.parquet", id=[5], like_count=pa.nulls(1), title=["z"])
    put(tmp_path, "d.parquet", id=[6], title=["w"])
    put(tmp_path, "other.txt.parquet.bak", id=["no match"])
    got = files.scan_parquet_glob(spark, str(tmp_path), "*.parquet", provenance=True)
    assert got.schema["like_count"].dataType == T.DoubleType() and got.schema["title"].dataType == T.StringType()
    assert [(r["id"], r["like_count"], r["title"]) for r in rows(got)] == [(1, 5.0, "x"), (2, None, "y"), (3, 7.0, None), (4, None, None), (5, None, "z"), (6, None, "w")]
    assert [(r["source_file"].rsplit("/", 1)[1], r["source_row"]) for r in rows(got)] == [
        ("a.parquet", 0), ("a.parquet", 1), ("b.parquet", 0), ("b.parquet", 1), ("c.parquet", 0), ("d.parquet", 0)]


def test_null_column_takes_any_type(spark, tmp_path):
    day = dt.date(2024, 5, 1)
    put(tmp_path, "a.parquet", id=[1], seen=pa.nulls(1), tags=pa.nulls(1), flag=pa.array([None], pa.float64()))
    put(tmp_path, "b.parquet", id=[2], seen=pa.array([day]), tags=pa.array([["p"]]), flag=[True])
    got = files.scan_parquet_glob(spark, str(tmp_path), "*.parquet")
    assert [got.schema[c].dataType.simpleString() for c in ("seen", "tags", "flag")] == ["date", "array<string>", "boolean"]
    assert rows(got) == [{"id": 1, "seen": None, "tags": None, "flag": None}, {"id": 2, "seen": day, "tags": ["p"], "flag": True}]


def test_null_everywhere_but_of_two_types(spark, tmp_path):
    put(tmp_path, "a.parquet", id=[1], x=pa.array([None], pa.float64()))
    put(tmp_path, "b.parquet", id=[2], x=pa.array([None], pa.string()))
    assert [r["x"] for r in rows(files.scan_parquet_glob(spark, str(tmp_path), "*.parquet"))] == [None, None]


def test_given_schema_casts_whole_doubles_back(spark, tmp_path):
    put(tmp_path, "a.parquet", id=[1], n=pa.array([2.0]))
    put(tmp_path, "b.parquet", id=[2], n=pa.array([3], pa.int32()))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("gone", T.StringType())])
    assert rows(files.scan_parquet_glob(spark, str(tmp_path), "*.parquet", schema)) == [{"id": 1, "n": 2, "gone": None}, {"id": 2, "n": 3, "gone": None}]
    # One file alone differs from the schema as well.
    assert rows(files.scan_parquet_glob(spark, str(tmp_path), "a.parquet", schema)) == [{"id": 1, "n": 2, "gone": None}]


@pytest.mark.parametrize(("first", "second", "schema"), [
    (pa.array([2**53 + 1], pa.int64()), pa.array([0.5]), None),
    (pa.array([1.5]), pa.array([1], pa.int64()), "id long, n long"),
    (pa.array(["three"]), pa.array([1], pa.int64()), "id long, n long"),
    (pa.array([2**40], pa.int64()), pa.array([1.0]), "id long, n int"),
])
def test_no_value_is_lost_silently(spark, tmp_path, first, second, schema):
    put(tmp_path, "a.parquet", id=[1], n=first)
    put(tmp_path, "b.parquet", id=[2], n=second)
    got = files.scan_parquet_glob(spark, str(tmp_path), "*.parquet", schema and T._parse_datatype_string(schema))
    with pytest.raises(Exception, match="column n"):
        got.collect()


def test_text_next_to_numbers_and_times(spark, tmp_path):
    put(tmp_path, "a.parquet", id=[1], x=pa.array([12], pa.int64()), t=pa.array([dt.date(2024, 1, 2)]))
    put(tmp_path, "b.parquet", id=[2], x=["twelve"], t=pa.array([dt.datetime(2024, 1, 2, 3)], pa.timestamp("us", "UTC")))
    got = rows(files.scan_parquet_glob(spark, str(tmp_path), "*.parquet"))
    assert [r["x"] for r in got] == ["12", "twelve"] and [r["t"].hour for r in got] == [0, 3]


def test_nested_columns(spark, tmp_path):
    put(tmp_path, "a.parquet", id=[1, 2], s=pa.array([{"n": 1, "only": "q"}, None]), a=pa.array([[1, 2], None], pa.list_(pa.int32())))
    put(tmp_path, "b.parquet", id=[3], s=pa.array([{"n": 1.5}]), a=pa.array([[0.5]]))
    assert rows(files.scan_parquet_glob(spark, str(tmp_path), "*.parquet")) == [
        {"id": 1, "s": {"n": 1.0, "only": "q"}, "a": [1.0, 2.0]}, {"id": 2, "s": None, "a": None}, {"id": 3, "s": {"n": 1.5, "only": None}, "a": [0.5]}]


def test_partition_folders_and_odd_names(spark, tmp_path):
    for day, values in (("2024-01-01", pa.array([1], pa.int64())), ("2024-01-02", pa.array([2.0]))):
        (tmp_path / f"day={day}").mkdir()
        put(tmp_path / f"day={day}", "part [1]{x}.parquet", id=[int(day[-1])], n=values)
    got = rows(files.scan_parquet_glob(spark, str(tmp_path), "*.parquet"))
    assert [(r["id"], r["n"], str(r["day"])) for r in got] == [(1, 1.0, "2024-01-01"), (2, 2.0, "2024-01-02")]


def test_types_without_common_type(spark, tmp_path):
    put(tmp_path, "a.parquet", id=[1], x=pa.array([[1]]))
    put(tmp_path, "b.parquet", id=[2], x=["text"])
    with pytest.raises(NoCommonType, match="column x"):
        files.scan_parquet_glob(spark, str(tmp_path), "*.parquet")


def test_common_types():
    decimal = T.DecimalType
    assert common_type(T.ByteType(), T.LongType()) == T.LongType() == common_type(T.NullType(), T.LongType())
    assert common_type(decimal(10, 2), T.IntegerType()) == decimal(12, 2) and common_type(decimal(5, 4), decimal(9, 1)) == decimal(12, 4)
    assert common_type(T.FloatType(), T.LongType()) == T.DoubleType() and common_type(T.BooleanType(), T.LongType()) == T.StringType()
    assert common_type(T.DateType(), T.TimestampNTZType()) == T.TimestampNTZType()
    with pytest.raises(NoCommonType):
        common_type(decimal(38, 0), decimal(38, 20))
    with pytest.raises(NoCommonType):
        common_type(T.BinaryType(), T.StringType())


def test_few_footer_jobs_for_many_files(spark, tmp_path, monkeypatch):
    """64 files of two write jobs: halving follows the writers, and each class is one scan."""
    from talkmill.sources import mixed

    one, two = "0" * 8 + "-0000-0000-0000-" + "0" * 12, "1" * 8 + "-0000-0000-0000-" + "0" * 12
    for i in range(32):
        put(tmp_path, f"part-{i:05d}-{one}.parquet", id=[i], n=[i])
        put(tmp_path, f"part-{i:05d}-{two}.parquet", id=[i], n=[i / 2])
    asked, plain = [], mixed.merged_schema
    monkeypatch.setattr(mixed, "merged_schema", lambda *a: asked.append(1) or plain(*a))
    classes = file_classes(spark, [str(p) for p in tmp_path.iterdir()])
    assert sorted(len(c.paths) for c in classes) == [32, 32] and len(asked) == 3


def test_matching_folder_is_a_table(spark, tmp_path):
    put(tmp_path, "a.parquet", id=[1, 2], title=["x", "y"])
    for folder in ("b.parquet", "c.csv", "k=1"):
        (tmp_path / folder).mkdir()
    put(tmp_path / "b.parquet", "part-0.parquet", id=[3], extra=[0.5])
    put(tmp_path / "b.parquet", "part-1", id=[4], extra=[1.5])
    put(tmp_path / "c.csv", "part-0", id=[5])
    got = files.scan_parquet_glob(spark, str(tmp_path), "{a,b,missing}.parquet", provenance=True)
    assert [(r["id"], r["title"], r["extra"]) for r in rows(got)] == [(1, "x", None), (2, "y", None), (3, None, 0.5), (4, None, 1.5)]
    put(tmp_path / "b.parquet", "part-2", id=[6], title=[7])  # types that do not merge
    assert [(r["id"], r["title"]) for r in rows(files.scan_parquet_glob(spark, str(tmp_path), "?.parquet"))] == [(1, "x"), (2, "y"), (3, None), (4, None), (6, "7")]
