from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from talkmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Values of one text function over a list of texts."""
    from pyspark.sql import functions as F

    def run(texts, function):
        rows = [(i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "i int, t string").select("i", function(F.col("t")).alias("x"))
        return [r["x"] for r in sorted(df.collect(), key=lambda r: r["i"])]

    return run
