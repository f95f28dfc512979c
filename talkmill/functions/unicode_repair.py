"""The one step Spark has no built-in for: encoding repair, entity decoding and NFKC."""

from __future__ import annotations

import html
import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from talkmill.functions.lexicons import MOJIBAKE_MARKERS
from talkmill.functions.patterns import NEEDS_UNICODE_WORK, PLAIN_ASCII

# The functions below travel to the executors by value: workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _damage(text: str) -> int:
    return text.count("\ufffd") + sum(map(text.count, MOJIBAKE_MARKERS))


def undo_double_encoding(text: str) -> str:
    """Re-read UTF-8 that was decoded as Latin-1 or Windows-1252, when that lowers the damage."""
    if not any(map(text.__contains__, MOJIBAKE_MARKERS)):
        return text
    best, least = text, _damage(text)
    for codec in ("latin-1", "cp1252"):
        raw = text.encode(codec, "ignore")
        try:
            reread = raw.decode()
        except UnicodeDecodeError:
            continue
        if _damage(reread) < least:
            best, least = reread, _damage(reread)
    return best


def readable_form(text: str) -> str:
    """Encoding repair, then HTML entities, then NFKC."""
    return unicodedata.normalize("NFKC", html.unescape(undo_double_encoding(text)))


def _arrow(fn):
    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(fn, na_action="ignore")

    return apply


_UDFS: dict[str, object] = {}


def _python_step(fn, c: Column) -> Column:
    # A Python UDF inside CASE runs for every row, so rows that need no work send a null
    # to the worker instead of their text; the scan and the plan stay single.
    if fn.__name__ not in _UDFS:
        _UDFS[fn.__name__] = _arrow(fn)
    residue = F.regexp_replace(c, PLAIN_ASCII, "")
    return F.coalesce(_UDFS[fn.__name__](F.when(residue.rlike(NEEDS_UNICODE_WORK), c)), c)


def repair_mojibake(c: Column) -> Column:
    return _python_step(undo_double_encoding, c)


def _entities_and_nfkc(text: str) -> str:
    return unicodedata.normalize("NFKC", html.unescape(text))


def normalize_unicode(c: Column) -> Column:
    return _python_step(_entities_and_nfkc, c)


def repair_and_normalize(c: Column) -> Column:
    """Both steps in one trip through the Python worker."""
    return _python_step(readable_form, c)
