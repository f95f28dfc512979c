"""Reports filled while a table is written."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.plans import jobs
from talkmill.sources import files


def test_reports_equal_a_second_scan(spark, tmp_path):
    df = spark.range(1000).withColumn("flag", F.col("id") % 3 == 0).repartition(7)
    columns = {"a": [F.count("*").alias("n"), F.count_if("flag").alias("hits")], "b": [F.min("id").alias("low"), F.bool_and(F.col("id") >= 0).alias("all")]}
    for folder in (None, str(tmp_path)):
        table, reports = jobs.staged_with(df, folder, "t", columns)
        assert table.count() == 1000
        assert reports["a"].first().asDict() == {"n": 1000, "hits": 334} and reports["b"].first().asDict() == {"low": 0, "all": True}


def test_source_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(100).repartition(3).mapInArrow(count, "id long")
    table, reports = jobs.staged_with(df, str(tmp_path), "t", {"r": [F.count("*").alias("n")], "s": [F.max("id").alias("m")]})
    assert (table.count(), reports["r"].first().n, reports["s"].first().m) == (100, 100, 99) and seen.value == 100


def test_empty_tables(spark, tmp_path):
    for empty in (spark.range(10).where("id > 100"), spark.createDataFrame([], "id long")):
        table, reports = jobs.staged_with(empty, str(tmp_path), "t", {"r": [F.count("*").alias("n"), F.max("id").alias("m")]})
        assert table.count() == 0 and reports["r"].first().asDict() == {"n": 0, "m": None}
    (tmp_path / "e.csv").write_text("a,b\n")
    assert files.scan_csv(spark, str(tmp_path / "e.csv")).collect() == []
    assert files.scan_csv(spark, str(tmp_path / "e.csv")).columns == ["a", "b"]


def test_two_runs_with_one_folder(spark, tmp_path):
    first = jobs.staged(spark.range(5), str(tmp_path), "t")
    jobs.staged(first.where("id < 2"), str(tmp_path), "t")
    assert first.count() == 5
