"""Dictionary-based English rendering of romanised text.

The dictionary is a parameter (romanised word or phrase -> English), kept by the user as a table:
see :func:`talkmill.sources.files.dictionary_table` and :mod:`talkmill.operators.matching`, which
takes tables of any size. The functions here are columns, for dictionaries the driver holds.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from talkmill.functions.keywords import Keywords
from talkmill.functions.text import strip, words


def _entries(dictionary: dict[str, str]) -> Keywords:
    return Keywords(SparkSession.active(), {key.lower(): value for key, value in dictionary.items()}, whole_words=True)


def normalize_romanized(c: Column, dictionary: dict[str, str]) -> Column:
    """Lower-case the text and replace whole words and phrases: the leftmost, of those the longest."""
    return F.when(strip(c) == "", c).otherwise(_entries(dictionary).replaced(F.lower(c)))


def is_dictionary_dominated(c: Column, dictionary: dict[str, str], share: float = 0.15) -> Column:
    """At least ``share`` of the whitespace tokens are dictionary entries."""
    tokens = words(F.lower(c))
    return F.coalesce((F.size(tokens) > 0) & (_entries(dictionary).token_hits(tokens) / F.size(tokens) >= share), F.lit(False))
