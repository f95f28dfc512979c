"""SQL spellings of the column functions, written for a regex engine without look-around."""

from __future__ import annotations

from talkmill.checks.bindings import ANNOTATED_SQL, COMMENTS_SQL, lit, lits
from talkmill.functions import lexicons as X
from talkmill.functions.patterns import WHITESPACE

_WS = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
URL_ANY = rf"(?i)https?://[^{_WS}]+|(^|{NOT_WORD})www\.[^{_WS}]+"


def rep(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def hits(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


def strip(x: str) -> str:
    return f"trim({x}, {lit(WHITESPACE)})"


def unreadable(x: str) -> str:
    return rep(x, r"[\x00-\x08\x0e-\x1b\x7f-\x{84}\x{86}-\x{9f}\p{Cf}\p{Co}\x{FFFD}]", "")


def no_html(x: str) -> str:
    return rep(x, "<[^>]+>", " ")


def no_urls(x: str) -> str:
    return rep(x, URL_ANY, r"\1 ")


def punctuation(x: str) -> str:
    for mark in "!?.;,":
        x = rep(x, rf"[{mark}]{{2,}}", mark)
    return x


def whitespace(x: str) -> str:
    return strip(rep(x, f"[{_WS}]+", " "))


def clean(x: str) -> str:
    return f"coalesce({whitespace(punctuation('lower(' + no_urls(no_html(unreadable(x))) + ')'))}, '')"


def decode_entities(x: str) -> str:
    """The entities that occur in the page table; '&amp;' last."""
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, {lit(name)}, {lit(char)})"
    return rep(x, r"&amp", "&")


def contains_any(x: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(m)})" for m in markers) + ")"


def is_empty(x: str) -> str:
    return f"coalesce({strip(x)} = '', true)"


def is_deleted(x: str) -> str:
    return f"coalesce(lower({strip(x)}) IN ({lits(X.DELETED_MARKERS)}), false)"


def is_short(x: str) -> str:
    return f"coalesce(length({strip(x)}) < 3, true)"


def is_single_word(x: str) -> str:
    return f"coalesce(len(string_split_regex({strip(x)}, {lit(f'[{_WS}]+')})) = 1 AND {strip(x)} <> '', false)"


def url_count(x: str) -> str:
    return hits(x, URL_ANY)


def promo(x: str) -> str:
    return contains_any(f"lower({x})", X.PROMOTIONAL_MARKERS)


def solicitation(x: str) -> str:
    return contains_any(f"lower({x})", X.SOLICITATION_MARKERS)


def link_only(x: str) -> str:
    rest = no_urls(x)
    return f"({has(x, URL_ANY)} AND (NOT {has(rest, WORD)} OR ({hits(rest, WORD + '+')} <= 10 AND {promo(x)})))"


def emoji_only(x: str) -> str:
    text, symbol = r"[\p{L}\p{N}]", r"[\p{S}\p{M}\p{P}]"
    return f"(NOT {has(x, text)} AND {has(x, symbol)})"


_REPEATABLE = "abcdefghijklmnopqrstuvwxyz0123456789äçèéêíñóöüß"
_MARKS = " !\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\"


def repeated(x: str) -> str:
    runs = [f"{c}{{6,}}" for c in _REPEATABLE] + [f"\\x{ord(c):02x}{{6,}}" for c in _MARKS] + ["(🔥){6,}"]
    return has(f"lower({x})", "|".join(runs))


def is_spam(x: str) -> str:
    v = strip(x)
    rules = " OR ".join([
        promo(v), solicitation(v), emoji_only(v), repeated(v), f"{url_count(v)} >= 2", link_only(v),
    ])
    return f"coalesce({v} <> '' AND ({rules}), false)"


def _block(name: str) -> str:
    low, high = X.SCRIPT_BLOCKS[name]
    return f"[\\x{{{ord(low):04x}}}-\\x{{{ord(high):04x}}}]"


def script_hits(x: str) -> str:
    structs = ", ".join(f"{{'r': -{hits(x, _block(n))}, 'n': {lit(n)}}}" for n in X.SCRIPT_BLOCKS)
    return f"list_sort([s FOR s IN [{structs}] IF s.r < 0])"


def marker(x: str, words: list[str]) -> str:
    return f"list_has_any(regexp_extract_all(lower({x}), '[a-z]+'), [{lits(words)}])"


def detect_language(x: str) -> str:
    h, latin = script_hits(x), has(x, "[A-Za-z]")
    any_block = has(x, "|".join(_block(n) for n in X.SCRIPT_BLOCKS))
    mixed = (
        f"'mixed_' || array_to_string(list_slice(list_concat([s.n FOR s IN {h}], "
        f"CASE WHEN {latin} THEN ['english'] ELSE [] END), 1, 3), '_')"
    )
    return f"""CASE WHEN {x} IS NULL OR {strip(x)} = '' THEN 'unknown'
      WHEN {any_block} AND len({h}) = 1 AND NOT {latin} THEN ({h})[1].n
      WHEN {any_block} THEN {mixed}
      WHEN {marker(x, X.HINGLISH_MARKERS)} THEN 'hinglish'
      WHEN {marker(x, X.MALAYALAM_ROMAN_MARKERS)} THEN 'romanized_malayalam'
      WHEN {latin} THEN 'english' ELSE 'unknown' END"""


def lookup(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + " END"


def title(x: str) -> str:
    return rf"array_to_string([upper(t[1]) || lower(t[2:]) FOR t IN regexp_extract_all({x}, '\p{{L}}+|[^\p{{L}}]+')], '')"


def slug(x: str) -> str:
    return f"coalesce(nullif(trim({rep('lower(' + strip(x) + ')', '[^a-z0-9]+', '_')}, '_'), ''), 'product')"


def sentiment_tokens(x: str) -> str:
    return rf"[w FOR w IN regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+') IF regexp_full_match(w, '[a-z]+')]"


def sentiment_score(t: str) -> str:
    """Score of a token list column."""
    value = f"CASE WHEN {t}[i] IN ({lits(X.POSITIVE_WORDS)}) THEN 1 WHEN {t}[i] IN ({lits(X.NEGATIVE_WORDS)}) THEN -1 ELSE 0 END"
    factor = f"CASE WHEN i > 1 AND {t}[i-1] IN ({lits(X.INTENSIFIERS)}) THEN 2 WHEN i > 1 AND {t}[i-1] IN ({lits(X.NEGATORS)}) THEN -1 ELSE 1 END"
    return f"coalesce(CAST(list_sum([({value}) * ({factor}) FOR i IN range(1, len({t}) + 1)]) AS BIGINT), 0)"


def sentiment_label(score: str) -> str:
    return f"CASE WHEN {score} > 0 THEN 'Positive' WHEN {score} < 0 THEN 'Negative' ELSE 'Neutral' END"


def terms(x: str, stop: list[str] = ()) -> str:
    found = rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]{{2,}}')"
    return f"[w FOR w IN {found} IF w NOT IN ({lits(stop)})]" if stop else found


def display_name(keyword: str) -> str:
    return keyword.title() if keyword[:1].isalpha() else keyword


def competitors(text: str, product: str) -> str:
    def names(keywords: list[str]) -> str:
        structs = ", ".join(f"{{'k': {lit(k)}, 'n': {lit(display_name(k))}}}" for k in keywords)
        return f"[s.n FOR s IN [{structs}] IF contains(lower({text}), s.k)]"

    own = " ".join(f"WHEN {lit(p)} THEN {names(k)}" for p, k in X.COMPETITOR_KEYWORDS.items())
    return f"list_distinct(list_concat(CASE {product} {own} ELSE [] END, {names(X.DEFAULT_COMPETITORS)}))"


def with_comments(body: str, *more: str) -> str:
    return "WITH " + ", ".join([COMMENTS_SQL, *more]) + "\n" + body


FLAGGED = f"""cleaned AS (SELECT *, {clean('comment_text')} AS cleaned_comment_text FROM comments),
flags AS (SELECT *, {is_empty('cleaned_comment_text')} AS is_empty, {is_deleted('comment_text')} AS is_deleted,
  {is_short('cleaned_comment_text')} AS is_short_comment, {is_single_word('cleaned_comment_text')} AS is_single_word,
  {is_spam('comment_text')} AS is_spam FROM cleaned),
flagged AS (SELECT *, is_empty OR is_deleted OR is_short_comment OR is_single_word OR is_spam AS is_removed_by_cleaning FROM flags)"""

SCORED = f"""toks AS (SELECT *, {sentiment_tokens('comment_text')} AS tk FROM comments),
points AS (SELECT * EXCLUDE (tk), {sentiment_score('tk')} AS score FROM toks),
scored AS (SELECT *, {sentiment_label('score')} AS predicted_sentiment FROM points)"""


def with_flagged(body: str, *more: str) -> str:
    return with_comments(body, FLAGGED, *more)


def with_scored(body: str, *more: str) -> str:
    return with_comments(body, SCORED, *more)


def with_annotated(body: str, *more: str) -> str:
    return with_comments(body, ANNOTATED_SQL, *more)
