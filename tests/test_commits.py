"""A product is there as a whole or not at all."""

from __future__ import annotations

import pytest

from talkmill.sources import commits


def table(spark, rows):
    return spark.createDataFrame(rows, "product_slug string, n int").repartition(3)


def now(spark, path):
    return sorted((r.product_slug, r.n) for r in commits.read_products(spark, path).collect())


def test_commits_replacement_and_killed_jobs(spark, tmp_path):
    path = str(tmp_path / "out")
    incoming = table(spark, [("a", 1), ("a", 2), ("b", 3), ("c", 4)])
    assert commits.still_to_do(incoming, path).count() == 4
    commits.write_products(incoming.where("product_slug <> 'c'"), path)
    assert now(spark, path) == [("a", 1), ("a", 2), ("b", 3)]
    assert [r.n for r in commits.still_to_do(incoming, path).collect()] == [4]
    # A job that dies between data and manifest: its data is not seen and the product is done again.
    table(spark, [("c", 4), ("a", 99)]).write.partitionBy("product_slug").parquet(f"{path}/data/run=dead")
    assert now(spark, path) == [("a", 1), ("a", 2), ("b", 3)]
    assert [r.n for r in commits.still_to_do(incoming, path).collect()] == [4]
    commits.write_products(table(spark, [("c", 4), ("a", 7)]), path)
    assert now(spark, path) == [("a", 7), ("b", 3), ("c", 4)]
    assert commits.still_to_do(incoming, path).count() == 0
    assert {r.product_slug: r.rows for r in commits.committed(spark, path).collect()} == {"a": 1, "b": 2 - 1, "c": 1}


def test_job_killed_in_the_middle_of_its_data(spark, tmp_path):
    path = str(tmp_path / "out")
    commits.write_products(table(spark, [("a", 1)]), path)
    broken = table(spark, [("b", i) for i in range(10)]).selectExpr("product_slug", "CASE WHEN n = 7 THEN raise_error('killed') ELSE n END AS n")
    with pytest.raises(Exception, match="killed"):
        commits.write_products(broken.selectExpr("product_slug", "cast(n as int) n"), path)
    assert now(spark, path) == [("a", 1)]
    assert commits.still_to_do(table(spark, [("b", 1)]), path).count() == 1


def test_nothing_written(spark, tmp_path):
    path = str(tmp_path / "out")
    commits.write_products(table(spark, []), path)
    assert commits.committed(spark, path).collect() == []
    with pytest.raises(FileNotFoundError):
        commits.read_products(spark, path)
    commits.write_products(table(spark, [("007", 1), ("2024", 3), ("a b/c", 2)]), path)
    commits.write_products(table(spark, [("12", 1)]), path)
    assert now(spark, path) == [("007", 1), ("12", 1), ("2024", 3), ("a b/c", 2)]
    assert commits.still_to_do(table(spark, [("007", 1), ("7", 1)]), path).collect()[0].product_slug == "7"
