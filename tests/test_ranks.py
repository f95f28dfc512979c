"""Running totals and quantiles over many ranges."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmill.operators import profiling as PR, ranks, sampling as SA


@pytest.mark.parametrize("range_rows", [3, 50, 10**6])
@pytest.mark.parametrize("kind", ["distinct", "repeated", "floating", "one"])
def test_against_numpy(spark, monkeypatch, kind, range_rows):
    monkeypatch.setattr(ranks, "RANGE_ROWS", range_rows)
    rng = random.Random(5)
    values = {"distinct": [i * 7 - 900 for i in range(500)], "repeated": [rng.choice([1, 1, 1, 5, 9, 2**60]) for _ in range(300)],
              "floating": [rng.gauss(0, 10) ** 3 for _ in range(400)], "one": [4]}[kind]
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double" if kind == "floating" else "x long").repartition(4)
    counts = ranks.value_counts_of(df, F.col("x"))
    totals = {r.value: (r.upto, r.total) for r in ranks.with_running_totals(counts).collect()}
    assert totals == {v: (sum(x <= v for x in values), len(values)) for v in set(values)}
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    assert ranks.quantiles(counts, shares).first().q == pytest.approx(list(np.quantile(np.array(values, float), shares)), rel=1e-12)
    got = PR.describe(df, F.col("x")).first()
    assert (got["count"], got["min"], got["max"]) == (len(values), min(values), max(values))
    assert got["mean"] == pytest.approx(sum(values) / len(values)) and (got["std"] is None if kind == "one" else got["std"] == pytest.approx(np.std(np.array(values, float), ddof=1)))
    stats = SA.weight_stats(df, "x").first()
    assert stats.upper_median == sorted(values)[len(values) // 2]


def test_nothing(spark):
    df = spark.createDataFrame([(None,)], "x long")
    assert PR.describe(df, F.col("x")).first().asDict() == {"count": 0, "mean": None, "std": None, "min": None, "q25": None, "q50": None, "q75": None, "max": None}
    assert SA.weight_stats(df, "x").first().upper_median is None


def test_no_task_holds_the_values(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 1000)
    counts = ranks.value_counts_of(spark.range(50_000), F.col("id") * 3)
    ranged = ranks.with_running_totals(counts)
    assert ranged.count() == 50_000
    bounds = ranks.boundaries(counts)
    widest = max(b - a for a, b in zip([0, *bounds], [*bounds, 150_000])) / 3
    assert len(bounds) >= 45 and widest < 3000
