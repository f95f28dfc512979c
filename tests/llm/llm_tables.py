"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind string, fp long, shard int, key long, word string, block long, _n long, _key string, removed string, _id string, _hash string, stays string"
WORDS = "ab cd ef gh ij kl mn op qr st uv wx yz la le lo ti to ta".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def table_of(spark, rows: list[tuple]):
    """(doc_id, text[, lang]) rows with extra columns whose names clash with working columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "k", 1, 2, 3, "w", 4, 5, "x", "y", "i", "h", "z") for r in rows]
    return spark.createDataFrame(full, SCHEMA)
