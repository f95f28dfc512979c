"""CSV cut at any place reads as the one-task reader reads it."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import types as T

from talkmill.sources import files, split_csv


@pytest.fixture
def small_pieces(spark):
    """Files are cut every few dozen bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield cut
    for k, v in before.items():
        spark.conf.set(k, v)


FIELDS = ["plain", "", 'say "hi"', "a,b", "two\nlines", "\n\n", '"', '""\n"', "x" * 90, "ends\n", 'inch 5" wide', ",\n,", "ünï\n日本", "a\n" * 30]


def written(path, rows, line_end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=line_end).writerows(rows)


def as_rows(df):
    return sorted([tuple("" if v is None else v for v in r) for r in df.collect()])


@pytest.mark.parametrize("size", [16, 37, 200, 1 << 20])
def test_cut_anywhere(spark, tmp_path, small_pieces, size):
    rng = random.Random(size)
    folder = tmp_path / "t"
    folder.mkdir()
    rows = [(str(i), rng.choice(FIELDS), rng.choice(FIELDS)) for i in range(150)]
    written(folder / "a.csv", [("id", "first", "a second\ncolumn"), *rows[:90]])
    written(folder / "b.csv", [("id", "first", "a second\ncolumn"), *rows[90:]])
    (folder / "c.csv").write_text("id,first,a third header\n")
    (folder / "d.csv").write_text("")
    small_pieces(size)
    schema = T._parse_datatype_string("id string, x string, y string")
    got = files.scan_csv(spark, str(folder), schema)
    assert as_rows(got) == sorted(rows)
    plain = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(str(folder))
    assert as_rows(got) == as_rows(plain)


def test_windows_line_ends_blank_lines_and_mark(spark, tmp_path, small_pieces):
    small_pieces(23)
    (tmp_path / "w.csv").write_bytes('﻿id,"te""xt"\r\n1,"a\r\nb"\r\n\r\n2,c\r\n3,"d ""q"" e"'.encode())
    got = files.scan_csv(spark, str(tmp_path / "w.csv"))
    assert got.columns == ["id", 'te"xt'] and got.schema["id"].dataType == T.IntegerType()
    assert [r[1].replace("\r\n", "\n") for r in sorted(got.collect())] == ["a\nb", "c", 'd "q" e']


def test_types_are_found_in_the_pass(spark, tmp_path):
    rows = [("i", "l", "d", "day", "at", "yes", "s", "none"), ("1", "3000000000", "1.5", "2024-01-02", "2024-01-02 03:04:05", "true", "x", ""), ("-7", "2", "1e3", "2024-02-29", "2024-01-02T03:04:05Z", "FALSE", "1", ""), ("", "", "", "", "", "", "", "")]
    written(tmp_path / "t.csv", rows)
    got = files.scan_csv(spark, str(tmp_path / "t.csv"))
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["int", "bigint", "double", "date", "timestamp", "boolean", "string", "string"]
    assert [r.i for r in got.collect()] == [1, -7, None]


def test_large_file_is_read_by_many_tasks(spark, tmp_path, small_pieces):
    written(tmp_path / "t.csv", [("id", "t"), *[(i, f"text {i}\nover lines") for i in range(20_000)]])
    small_pieces(50_000)
    lines = split_csv.lines_of(spark, str(tmp_path / "t.csv"))
    assert lines.rdd.getNumPartitions() > 10
    got = files.scan_csv(spark, str(tmp_path / "t.csv"), T._parse_datatype_string("id long, t string"))
    assert got.count() == 20_000 and got.where("t <> concat('text ', id, '\nover lines')").count() == 0


@pytest.mark.parametrize(("line", "out", "inside"), [
    ("a,b", False, True), ('"a', True, False), ('a "b', False, False), ('"a""b"', False, False), ('","', False, True), ('""', False, True),
    ('x,"y"",', True, False), ('"a" b"c', False, False), ('a" b,"c', True, True), ('"', True, False), ('"",', False, True),
])
def test_states(line, out, inside):
    assert split_csv.ends_inside(line, False) is out and split_csv.ends_inside(line, True) is inside
