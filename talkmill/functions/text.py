"""Text cleaning as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from talkmill.functions import patterns as P
from talkmill.functions.bigrams import shared_bigrams
from talkmill.functions.binding import let
from talkmill.functions.lexicons import WATCH_URL
from talkmill.functions.unicode_repair import repair_and_normalize


def strip(c: Column) -> Column:
    """Trim Unicode whitespace (SQL ``trim`` removes only U+0020)."""
    return F.btrim(c, F.lit(P.WHITESPACE))


def non_ascii_residue(c: Column) -> Column:
    """The characters left when printable ASCII (without '&') is taken out: a cheap pre-test."""
    return F.regexp_replace(c, P.PLAIN_ASCII, "")


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def _contains_any(c: Column, parts: list[str]) -> Column:
    return reduce(or_, (c.contains(part) for part in parts))


# Each step first asks a cheap question and runs its regex only on texts that need it.
# let() binds the input, which would otherwise be repeated in test, regex and fallback.

def remove_unreadable(c: Column) -> Column:
    return let(c, lambda v: F.when(
        non_ascii_residue(v).rlike(P.UNREADABLE), F.regexp_replace(v, P.UNREADABLE, "")
    ).otherwise(v))


def remove_html(c: Column) -> Column:
    return let(c, lambda v: F.when(v.contains("<"), F.regexp_replace(v, P.TAG, " ")).otherwise(v))


def remove_urls(c: Column) -> Column:
    return let(c, lambda v: F.when(
        let(F.lower(v), lambda low: _contains_any(low, ["http", "www."])), F.regexp_replace(v, P.URL, " ")
    ).otherwise(v))


def collapse_punctuation(c: Column) -> Column:
    return let(c, lambda v: F.when(
        _contains_any(v, ["!!", "??", "..", ";;", ",,"]), F.regexp_replace(v, P.REPEATED_PUNCTUATION, "$1")
    ).otherwise(v))


def normalize_whitespace(c: Column) -> Column:
    plain = let(c, lambda v: F.when(
        ~is_ascii(v) & v.rlike(P.EXOTIC_WS_CLASS), F.translate(v, P.EXOTIC_WS, " " * len(P.EXOTIC_WS))
    ).otherwise(v))
    return strip(F.regexp_replace(plain, P.UNEVEN_WS, " "))


def clean_decoded(c: Column) -> Column:
    """The cleaning steps that follow Unicode repair; all of them stay in the JVM."""
    readable = remove_urls(remove_html(remove_unreadable(c)))
    return normalize_whitespace(collapse_punctuation(F.lower(readable)))


def clean_text(c: Column) -> Column:
    """Cleaned comment text; null becomes the empty string."""
    return F.coalesce(clean_decoded(repair_and_normalize(c)), F.lit(""))


def words(c: Column) -> Column:
    """Whitespace tokens; an empty array for blank text."""
    trimmed = strip(c)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, P.WS_RUN))


def word_count(c: Column) -> Column:
    """Number of whitespace tokens, counted without building the array."""
    return let(normalize_whitespace(c), lambda v: F.when(v == "", F.lit(0)).otherwise(
        F.length(v) - F.length(F.replace(v, F.lit(" "))) + 1
    ))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every letter run, lower-case the others."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(runs, F.initcap), "")


def preview(c: Column, length: int) -> Column:
    return F.substring(c, 1, length)


def product_slug(c: Column) -> Column:
    """File-name form of a product name."""
    slug = F.btrim(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("product"))


def watch_url(video_id: Column) -> Column:
    return F.concat(F.lit(WATCH_URL), video_id)


def token_set_intersect(c: Column, words: list[str]) -> Column:
    """Sorted distinct words of a list that occur in a text, ignoring case."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0))
    return F.array_sort(F.array_intersect(found, F.array(*[F.lit(w) for w in words])))


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Share of common character bigrams: 1 for two blanks, 0 for one blank."""
    texts = F.struct(
        normalize_whitespace(F.lower(a)).alias("a"), normalize_whitespace(F.lower(b)).alias("b")
    )
    # Equal texts and nulls need no comparison and are sent as null.
    differing = let(texts, lambda t: F.when(t.a != t.b, t))
    return F.coalesce(shared_bigrams(differing), F.when(a.isNotNull() & b.isNotNull(), F.lit(1.0)))
