"""Label normalisation and small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from talkmill.functions.lexicons import NOTE_LABELS
from talkmill.functions.text import strip, title_case


def normalize_sentiment_label(c: Column) -> Column:
    """Null or blank is Neutral, otherwise trimmed title case."""
    return F.when(c.isNull() | (strip(c) == ""), F.lit("Neutral")).otherwise(title_case(strip(c)))


def normalize_aspect(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("Other"))


def normalize_note(c: Column) -> Column:
    """Trimmed title-case note; blank becomes null."""
    return F.nullif(title_case(strip(c)), F.lit(""))


def label_key(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def note_columns(note: Column) -> dict[str, Column]:
    """One 0/1 column per note label."""
    present = F.coalesce(note, F.lit(""))
    return {
        "is_" + label.lower().replace(" ", "_"): (present == label).cast("int")
        for label in NOTE_LABELS
    }


def lowercase_keys(m: Column) -> Column:
    return F.transform_keys(m, lambda k, _: F.lower(k))


def is_filled(c: Column) -> Column:
    """Non-null and not blank."""
    return F.coalesce(strip(c) != "", F.lit(False))


def safe_long(c: Column) -> Column:
    """Integer value of text such as ' 42 ', null when it is none."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf(inity)?|nan)\s*$"


def coerce_numeric(c: Column) -> Column:
    """Number in a text, else null. The JVM would also read a type suffix ('1d', '3F')."""
    text = c.cast("string")
    return F.when(text.rlike(f"(?i){NUMBER}"), text.try_cast("double"))


def like_weight(likes: Column, cap: int = 10) -> Column:
    """Training weight 1 + log2(1 + likes), capped."""
    return F.least(F.lit(1.0) + F.log2(F.lit(1) + likes), F.lit(float(cap)))


def percent(part: Column, total: Column, digits: int | None = 2) -> Column:
    """Share in percent, 0 for an empty total."""
    share = F.when(total == 0, F.lit(0.0)).otherwise(part / total * 100)
    return share if digits is None else F.round(share, digits)
