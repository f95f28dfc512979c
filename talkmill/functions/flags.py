"""Quality flags as boolean Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from talkmill.functions import lexicons as X, patterns as P
from talkmill.functions.binding import let
from talkmill.functions.text import strip


def contains_any(c: Column, markers: list[str]) -> Column:
    """Any marker as a substring; bind a computed ``c`` with let() first."""
    return reduce(or_, (c.contains(m) for m in markers))


def is_empty(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def is_deleted(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(X.DELETED_MARKERS), F.lit(False))


def is_short(c: Column, minimum: int = 3) -> Column:
    return F.coalesce(F.length(strip(c)) < minimum, F.lit(True))


def is_single_word(c: Column) -> Column:
    trimmed = strip(c)
    return F.coalesce((trimmed != "") & ~trimmed.rlike(f"[{P.WS}]"), F.lit(False))


def has_many_urls(c: Column, minimum: int = 2) -> Column:
    return F.regexp_count(c, F.lit(P.URL)) >= minimum


def has_promo_text(c: Column) -> Column:
    return let(F.lower(c), lambda low: contains_any(low, X.PROMOTIONAL_MARKERS))


def is_solicitation(c: Column) -> Column:
    return let(F.lower(c), lambda low: contains_any(low, X.SOLICITATION_MARKERS))


def is_link_only(c: Column) -> Column:
    rest = F.regexp_replace(c, P.URL, " ")
    few_words = F.regexp_count(rest, F.lit(P.WORD_RUN)) <= 10
    return c.rlike(P.URL) & (~rest.rlike(f"[{P.WORD}]") | (few_words & has_promo_text(c)))


def is_emoji_only(c: Column) -> Column:
    return ~c.rlike(P.LETTER_OR_NUMBER) & c.rlike(P.SYMBOL_MARK_PUNCTUATION)


def has_repeated_chars(c: Column) -> Column:
    return F.lower(c).rlike(P.REPEATED_CHARACTER)


def is_spam(c: Column) -> Column:
    """Any spam rule on the trimmed raw text, cheapest rules first; null or blank is not spam."""
    def rules(v: Column) -> Column:
        def with_lowered(low: Column) -> Column:
            marked = contains_any(low, X.PROMOTIONAL_MARKERS) | contains_any(low, X.SOLICITATION_MARKERS)
            # Every http link is a promotional marker, so only www links are left to count.
            links = low.contains("www.") & (has_many_urls(v) | is_link_only(v))
            return marked | is_emoji_only(v) | low.rlike(P.REPEATED_CHARACTER) | links

        return (v != "") & let(F.lower(v), with_lowered)

    return F.coalesce(let(strip(c), rules), F.lit(False))


def fails_final_cleanup(c: Column, minimum: int = 3) -> Column:
    """After translation: blank, emoji-only, URL-first, too short, one word, or missing."""
    value = strip(c)
    return F.coalesce(
        (value == "") | (F.length(value) < minimum) | value.startswith("http")
        | is_single_word(c) | is_emoji_only(value),
        F.lit(True),
    )


# Shape -> format of timestamps other than ISO 8601.
TIMESTAMPS = [
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}$", "y/M/d H:mm"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", "y/M/d H:mm:ss"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-y"),
    (r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2}$", "M-d-y H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/y H:mm"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, y"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM y"),
    (r"^[A-Z][a-z]{2}, \d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [A-Z]{3}$", "dd MMM y HH:mm:ss z"),
]


def is_invalid_url(c: Column) -> Column:
    """True for a non-null value without an http(s) scheme."""
    return F.coalesce(~strip(c).rlike(P.HTTP_URL), F.lit(False))


def is_invalid_timestamp(c: Column) -> Column:
    """True for a non-null value that no timestamp can be read from, in any of the common formats."""
    text = F.trim(c.cast("string"))
    # A format is tried only where its shape fits: the parser falls back to other rules otherwise.
    read = [F.try_to_timestamp(text)] + [
        F.when(text.rlike(shape), F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3,9}, (?=\d)", ""), F.lit(form))) for shape, form in TIMESTAMPS
    ]
    return c.isNotNull() & F.coalesce(*read).isNull()
