"""Competitor names mentioned in a text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from talkmill.functions.binding import let
from talkmill.functions.lexicons import COMPETITOR_KEYWORDS, DEFAULT_COMPETITORS


def display_name(keyword: str) -> str:
    return keyword.title() if keyword[:1].isalpha() else keyword


def _hits(lowered: Column, keywords: list[str]) -> list[Column]:
    return [F.when(lowered.contains(k.lower()), F.lit(display_name(k))) for k in keywords]


def extract_competitors(
    text: Column,
    product: Column,
    by_product: dict[str, list[str]] = COMPETITOR_KEYWORDS,
    default: list[str] = DEFAULT_COMPETITORS,
    exclude_self: bool = False,
) -> Column:
    """Distinct display names whose keyword occurs in the text (substring match)."""
    none = F.array().cast("array<string>")

    def found(lowered: Column) -> Column:
        own = [
            F.when(product == name, F.array_compact(F.array(*_hits(lowered, keywords))))
            for name, keywords in by_product.items()
        ]
        general = F.array_compact(F.array(*_hits(lowered, default)))
        return F.array_distinct(F.concat(F.coalesce(*own, none), general))

    names = F.coalesce(let(F.lower(text), found), none)
    return F.filter(names, lambda n: F.lower(n) != F.lower(product)) if exclude_self else names
