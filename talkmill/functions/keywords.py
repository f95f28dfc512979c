"""Keywords and phrases found in one pass over a text, however many there are.

A set of keywords becomes one automaton (Aho-Corasick); whole words and short phrases, which start and
end with a run of word characters, are looked up by the runs of a text instead. The set is sent to the
executors once and a text is read once, so the time depends on the text and on what is found in it, not on
the number of keywords. Sets too large for one automaton are split by :mod:`talkmill.operators.matching`.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

#: Finders that a Python worker keeps between tasks.
KEPT = 3
_FINDERS: OrderedDict[str, Finder] = OrderedDict()

Span = tuple[int, int, str]

#: Runs of the characters of :func:`in_word`.
_RUN = re.compile(r"\w+")
_CUT = re.compile(r"(\w+)")
_HEAD = re.compile(r"\W*(\w+)(\W+\w+)?")
#: The most runs of a phrase that is looked up; each number of runs is a look at every run of a text.
MOST_RUNS = 3
#: Lengths of the pieces that stand for keywords found anywhere in a text.
PIECES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 24)


@lru_cache(maxsize=1 << 16)
def in_word(char: str) -> bool:
    """Letters, numbers and the underscore, as :data:`talkmill.functions.patterns.WORD` has them."""
    return char == "_" or unicodedata.category(char)[0] in "LN"


def word_anchor(keyword: str) -> tuple[int, str]:
    """What a text has in it if a keyword occurs there as whole words, with the number of runs that tells its kind.

    The first two runs of word characters and what lies between, else the only one, else the first character.
    """
    head = _HEAD.match(keyword)
    if head is None:
        return 0, keyword[:1]
    return (1, head[1]) if head[2] is None else (2, head[1] + head[2])


def word_anchors(text: str, kinds: set[int]) -> set[str]:
    """All anchors of these kinds that :func:`word_anchor` may give for keywords of a text."""
    parts, found = _CUT.split(text), set()
    if 1 in kinds:
        found.update(parts[1::2])
    if 2 in kinds:
        found.update(map("".join, zip(parts[1::2], parts[2::2], parts[3::2])))
    if 0 in kinds:
        found.update(c for c in set(text) if not in_word(c))
    return found


def piece_anchor(keyword: str) -> tuple[int, str]:
    """The same for keywords found anywhere: the start of the longest part without blanks, with its length."""
    part = max(keyword.split(), key=len, default="")
    size = max(n for n in PIECES if n <= len(part))
    return size, part[:size]


def piece_anchors(part: str, kinds: set[int]) -> set[str]:
    """All anchors of these lengths in a part of a text without blanks."""
    return {part[i:i + n] for n in kinds for i in range(len(part) - n + 1)}


def runs_of(keyword: str) -> int:
    """The number of runs of a keyword that starts and ends with one, 0 for others."""
    if _RUN.fullmatch(keyword):
        return 1
    return len(_RUN.findall(keyword)) if keyword and in_word(keyword[0]) and in_word(keyword[-1]) else 0


def automaton_of(entries: dict[str, str]):
    built = ahocorasick.Automaton()
    for word, value in entries.items():
        built.add_word(word, (len(word), value))
    built.make_automaton()
    return built


class Finder:
    """Finds the keywords of a set. As whole words one that starts and ends with a run begins and ends where runs of the text do."""

    def __init__(self, entries: dict[str, str], whole_words: bool):
        self.whole_words = whole_words
        self.known: dict[int, dict[str, str]] = {}
        rest = {}
        for word, value in entries.items():
            n = runs_of(word) if whole_words else 0
            (self.known.setdefault(n, {}) if 0 < n <= MOST_RUNS else rest)[word] = value
        #: The longest first: of phrases that start together the one of most runs is the longest.
        self.sizes = sorted(self.known, reverse=True)
        self.automaton = automaton_of(rest) if rest else None

    def spans(self, text: str) -> Iterator[Span]:
        """(start, end, value) of every occurrence, also overlapping ones."""
        runs = [m.span() for m in _RUN.finditer(text)] if self.sizes else []
        for n in self.sizes:
            known = self.known[n]
            for (start, _), (_, end) in zip(runs, runs[n - 1:]):
                value = known.get(text[start:end])
                if value is not None:
                    yield start, end, value
        if self.automaton is not None:
            for last, (length, value) in self.automaton.iter(text):
                start, end = last + 1 - length, last + 1
                if self.whole_words and ((start and in_word(text[start - 1])) or (end < len(text) and in_word(text[end]))):
                    continue
                yield start, end, value

    def values(self, text: str) -> set[str]:
        """The different values of the keywords that occur."""
        if self.automaton is None and self.sizes == [1]:
            known = self.known[1]
            return {known[w] for w in set(_RUN.findall(text)) if w in known}
        return {v for _, _, v in self.spans(text)}

    def replaced(self, text: str) -> str:
        """The text with leftmost-longest occurrences replaced by their values."""
        if self.automaton is not None:
            return rebuilt(text, list(self.spans(text)))
        # What lies between the runs, and the runs at odd places.
        parts, i = _CUT.split(text), 1
        one, longer = self.known.get(1, {}), [n for n in self.sizes if n > 1]
        while i < len(parts):
            for n in longer:
                value = self.known[n].get("".join(parts[i:i + 2 * n - 1])) if i + 2 * n - 2 < len(parts) else None
                if value is not None:
                    parts[i:i + 2 * n - 1] = [value, *[""] * (2 * n - 2)]
                    i += 2 * n
                    break
            else:
                value = one.get(parts[i])
                if value is not None:
                    parts[i] = value
                i += 2
        return "".join(parts)


def _finder(key: str, shared, whole_words: bool) -> Finder:
    if key in _FINDERS:
        _FINDERS.move_to_end(key)
        return _FINDERS[key]
    built = _FINDERS[key] = Finder(shared.value, whole_words)
    while len(_FINDERS) > KEPT:
        _FINDERS.popitem(last=False)
    return built


def leftmost_longest(spans: list[Span]) -> list[Span]:
    """Spans without overlap: from left to right, of those that start together the longest."""
    chosen, free = [], 0
    for start, end, value in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= free:
            chosen.append((start, end, value))
            free = end
    return chosen


def rebuilt(text: str, spans: list[Span]) -> str:
    """The text with the chosen spans replaced by their values."""
    parts, at = [], 0
    for start, end, value in leftmost_longest(spans):
        parts += [text[at:start], value]
        at = end
    return "".join(parts) + text[at:]


def values_found(text: str, finder: Finder) -> list[str]:
    """Sorted distinct values of the keywords that occur."""
    return sorted(finder.values(text))


def any_found(text: str, finder: Finder) -> bool:
    return next(finder.spans(text), None) is not None


def all_replaced(text: str, finder: Finder) -> str:
    return finder.replaced(text)


class Keywords:
    """Keywords with a value each (by default themselves); blank ones are left out.

    Matching is exact: give lower-cased keywords and texts where case does not matter. With
    ``whole_words`` a keyword counts only where no letter, number or underscore adjoins it.
    """

    def __init__(self, spark: SparkSession, entries: list[str] | dict[str, str], whole_words: bool = False):
        values = entries if isinstance(entries, dict) else {k: k for k in entries}
        self.whole_words = whole_words
        self.size = len(values)
        self._key = uuid.uuid4().hex
        self._shared = spark.sparkContext.broadcast({k: v for k, v in values.items() if k})

    def _column(self, text: Column, kind: str, of) -> Column:
        key, shared, whole = self._key, self._shared, self.whole_words

        @F.pandas_udf(kind)
        def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            finder = _finder(key, shared, whole)
            for texts in batches:
                yield texts.map(lambda t: None if t is None else of(t, finder))

        return apply(text)

    def found(self, text: Column) -> Column:
        """Sorted distinct values of the keywords that occur; null text gives null."""
        return self._column(text, "array<string>", values_found)

    def occurs(self, text: Column) -> Column:
        """Whether any keyword occurs; null text gives null."""
        return self._column(text, "boolean", any_found)

    def replaced(self, text: Column) -> Column:
        """The text with leftmost-longest occurrences replaced by their values."""
        return self._column(text, "string", all_replaced)

    def token_hits(self, tokens: Column) -> Column:
        """How many elements of an array of tokens are keywords; null gives null."""
        shared = self._shared

        @F.pandas_udf("int")
        def apply(arrays: pd.Series) -> pd.Series:
            known = shared.value
            return arrays.map(lambda own: None if own is None else sum(t in known for t in own))

        return apply(tokens)
