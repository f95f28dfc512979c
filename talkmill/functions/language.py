"""Script- and marker-based language labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from talkmill.functions import lexicons as X, patterns as P
from talkmill.functions.binding import let
from talkmill.functions.text import is_ascii, strip


def _block(name: str) -> str:
    low, high = X.SCRIPT_BLOCKS[name]
    return f"[{low}-{high}]"


_ANY_BLOCK = "[" + "".join(f"{low}-{high}" for low, high in X.SCRIPT_BLOCKS.values()) + "]"
# One range around all blocks, much faster to test than eight.
_SPAN = "[" + min(low for low, _ in X.SCRIPT_BLOCKS.values()) + "-" + max(high for _, high in X.SCRIPT_BLOCKS.values()) + "]"
_LATIN = "[A-Za-z]"


def _marker_pattern(markers: list[str]) -> str:
    # One of the words as a maximal ASCII-letter run; stops at the first hit.
    return f"(?i)(?<![A-Za-z])(?:{'|'.join(markers)})(?![A-Za-z])"


def _script_hits(c: Column) -> Column:
    """Present scripts as (-count, name), most frequent first, ties by name."""
    counted = F.array(*[
        F.struct((-F.regexp_count(c, F.lit(_block(n)))).alias("rank"), F.lit(n).alias("name"))
        for n in X.SCRIPT_BLOCKS
    ])
    return F.array_sort(F.filter(counted, lambda s: s["rank"] < 0))


def indic_script_counts(c: Column) -> Column:
    """map<script, characters> of the scripts present."""
    return F.map_from_entries(
        F.transform(_script_hits(c), lambda s: F.struct(s["name"].alias("k"), (-s["rank"]).alias("v")))
    )


def mixed_label(hits: Column, has_latin: Column) -> Column:
    """``mixed_`` plus the first three of: scripts by frequency, then English."""
    names = F.transform(hits, lambda s: s["name"])
    tail = F.when(has_latin, F.array(F.lit("english"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("mixed_"), F.array_join(F.slice(F.concat(names, tail), 1, 3), "_"))


def has_hinglish_marker(c: Column) -> Column:
    return c.rlike(_marker_pattern(X.HINGLISH_MARKERS))


def has_malayalam_marker(c: Column) -> Column:
    return c.rlike(_marker_pattern(X.MALAYALAM_ROMAN_MARKERS))


def _indic_label(c: Column) -> Column:
    latin = c.rlike(_LATIN)

    def label(hits: Column) -> Column:
        alone = (F.size(hits) == 1) & ~latin
        return F.when(alone, hits[0]["name"]).otherwise(mixed_label(hits, latin))

    return let(_script_hits(c), label)


def detect_language(c: Column) -> Column:
    """Broad language label of one comment."""
    # Per-script counting happens only for text that has any Indic character at all.
    return (
        F.when(c.isNull() | (strip(c) == ""), F.lit("unknown"))
        .when(~is_ascii(c) & c.rlike(_SPAN) & c.rlike(_ANY_BLOCK), _indic_label(c))
        .when(has_hinglish_marker(c), F.lit("hinglish"))
        .when(has_malayalam_marker(c), F.lit("romanized_malayalam"))
        .when(c.rlike(_LATIN), F.lit("english"))
        .otherwise(F.lit("unknown"))
    )


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Value for a key of a small fixed table, null when absent."""
    # A map mentions the key once; a chain of comparisons would repeat its expression.
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


def language_code(label: Column) -> Column:
    """Translator code of a language label."""
    return lookup(F.lower(strip(label)), X.LANGUAGE_CODES)


def _script_class(name: str) -> str:
    # Arabic vowel signs and two Devanagari accents carry no script of their own.
    extra = {"Arabic": r"\x{064B}-\x{0655}\x{0670}", "Devanagari": r"\x{0951}\x{0952}"}.get(name, "")
    return rf"[\p{{Is{name}}}{extra}&&[\p{{L}}\p{{M}}]]"


def detect_script_code(c: Column) -> Column:
    """Translator code of the dominant script among the first 200 non-space characters."""
    head = F.regexp_extract(c, f"^(?:[{P.WS}]*[^{P.WS}]){{1,200}}", 0)
    sample = F.regexp_replace(head, P.WS_RUN, "")
    names = [*X.SCRIPT_CODES, *X.UNCODED_SCRIPTS]

    def pick(s: Column) -> Column:
        ranked = F.array_sort(F.array(*[
            F.struct(
                (-F.regexp_count(s, F.lit(_script_class(n)))).alias("rank"),
                F.regexp_instr(s, F.lit(_script_class(n))).alias("first"),
                F.lit(X.SCRIPT_CODES.get(n)).cast("string").alias("code"),
            )
            for n in names
        ]))
        enough = F.greatest(F.lit(2.0), F.length(s) * F.lit(0.2))
        return F.when(-ranked[0]["rank"] >= enough, ranked[0]["code"])

    return F.when(~is_ascii(head), let(sample, pick))
