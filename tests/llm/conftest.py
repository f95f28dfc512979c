from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_tables import sentence, table_of  # noqa: E402


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, near copies."""
    rng = random.Random(5)
    rows: list[tuple] = [(i, "\n".join(sentence(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "  \n\t "), (103, rows[3][1]), (104, rows[3][1].replace(" ", "  ")), (105, rows[4][1] + " extra"), (5, rows[5][1]),
             (None, "no id here"), (None, "no id here"), (None, None), (106, "Ünïcode ß 日本 🙂 word"), (107, "one"), (108, "one two"), (109, "x" * 5000),
             (110, "\n".join(sentence(rng, 12) for _ in range(400))), (111, "a\n\na\nA\n> a")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return table_of(spark, odd_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def none_at_all(spark):
    return table_of(spark, [])
