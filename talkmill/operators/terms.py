"""Frequent terms, n-grams and keyword counts."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from talkmill import schemas as S
from talkmill.functions import patterns as P
from talkmill.functions.binding import let
from talkmill.functions.flags import contains_any
from talkmill.operators.ranking import first_rows, stack_columns
from talkmill.session import checkpointing

# Runs of two or more word characters.
TERM = rf"[{P.WORD}]{{2,}}"


def tokens(c: Column, stop_words: list[str] = ()) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TERM), 0)
    return F.filter(found, lambda t: ~t.isin(list(stop_words))) if stop_words else found


def ngrams(c: Column, size: int, stop_words: list[str] = ()) -> Column:
    """Adjacent tokens joined by a space, after stop-word removal."""
    toks = tokens(c, stop_words)
    if size == 1:
        return toks
    none = F.array().cast("array<string>")

    def windows(t: Column) -> Column:
        # Neighbours are put together pairwise: cutting out every window of its own costs several times as much.
        n = F.size(t) - (size - 1)
        rest = [F.slice(t, i + 1, n) for i in range(size)]
        joined = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, F.lit(" "), y)), rest)
        return F.when(n > 0, joined).otherwise(none)

    return let(toks, windows)


def term_counts(df: DataFrame, text: str = S.CLEANED, size: int = 1, stop_words: list[str] = (), by: list[str] = ()) -> DataFrame:
    """Corpus count of every term; counts are combined before the shuffle."""
    return df.select(*by, F.explode(ngrams(F.col(text), size, stop_words)).alias("term")).groupBy(*by, "term").agg(
        F.count("*").alias("n")
    )


def top_terms(df: DataFrame, n: int, text: str = S.CLEANED, size: int = 1, stop_words: list[str] = (),
              drop: list[str] = ()) -> DataFrame:
    """The ``n`` most frequent terms; ``drop`` removes terms afterwards, as a post-filter."""
    top = term_counts(df, text, size, stop_words).orderBy(F.desc("n"), "term").limit(n)
    return top.filter(~F.col("term").isin(list(drop))) if drop else top


def top_terms_by(df: DataFrame, by: str, n: int, text: str = S.CLEANED, size: int = 1, stop_words: list[str] = ()) -> DataFrame:
    """The ``n`` most frequent terms of every group, all groups in one job."""
    counts = term_counts(df, text, size, stop_words, [by])
    return first_rows(counts, [by], [F.desc("n"), F.col("term")], n)


def whole_word(word: str) -> str:
    return rf"(?<![{P.WORD}]){word}(?![{P.WORD}])"


def _word_hits(text: str, words: list[str]) -> Column:
    """0/1 per word: occurs as a whole word, ignoring case. The substring test comes first."""
    def hits(low: Column) -> Column:
        return F.array(*[(low.contains(w) & low.rlike(whole_word(w))).cast("int") for w in words])

    return let(F.lower(F.coalesce(F.col(text), F.lit(""))), hits)


def keyword_rows(df: DataFrame, keywords: list[str], text: str = S.CLEANED) -> DataFrame:
    """Rows that contain each keyword as a whole word."""
    marked = df.select(_word_hits(text, keywords).alias("h"))
    counted = marked.agg(*[F.coalesce(F.sum(F.col("h")[i]), F.lit(0)).alias(f"_{i}") for i in range(len(keywords))])
    return stack_columns(counted, {f"_{i}": k for i, k in enumerate(keywords)}, "keyword", "n")


def feature_word_counts(df: DataFrame, features: dict[str, list[str]], text: str = S.CLEANED, by: list[str] = ()) -> DataFrame:
    """Per feature the summed rows of its keywords; a row may count for several keywords."""
    words = [w for ws in features.values() for w in ws]
    marked = df.select(*by, _word_hits(text, words).alias("h"))
    sums, at = [], 0
    for i, ws in enumerate(features.values()):
        in_row = reduce(add, [F.col("h")[at + k] for k in range(len(ws))])
        sums.append(F.coalesce(F.sum(in_row), F.lit(0)).alias(f"_{i}"))
        at += len(ws)
    return stack_columns(marked.groupBy(*by).agg(*sums), {f"_{i}": f for i, f in enumerate(features)}, "feature", "n", list(by))


def mentions_any(c: Column, keywords: list[str]) -> Column:
    """Any keyword as a substring, ignoring case; null text is no mention."""
    return F.coalesce(let(F.lower(c), lambda low: contains_any(low, [k.lower() for k in keywords])), F.lit(False))


def keyword_any_filter(df: DataFrame, keywords: list[str], text: str = S.CLEANED) -> DataFrame:
    return df.filter(mentions_any(F.col(text), keywords))


def feature_sentiment_counts(df: DataFrame, features: dict[str, list[str]], positive: list[str], negative: list[str],
                             text: str = S.CLEANED) -> DataFrame:
    """Per feature, mentioned or not: rows that mention it and any positive / any negative word; one scan."""
    c = F.col(text)
    good, bad = mentions_any(c, positive), mentions_any(c, negative)
    slim = df.select(good.alias("good"), bad.alias("bad"), F.array(*[
        F.when(mentions_any(c, words), F.lit(name)) for name, words in features.items()
    ]).alias("fs"))
    rows = slim.select("good", "bad", F.explode("fs").alias("feature")).filter("feature IS NOT NULL")
    counts = rows.groupBy("feature").agg(F.count_if("good").alias("positive"), F.count_if("bad").alias("negative"))
    every = df.sparkSession.createDataFrame([(name,) for name in features], "feature string")
    return every.join(counts, "feature", "left").na.fill(0, ["positive", "negative"])


def topic_phrases(df: DataFrame, by: str, key: str, n: int = 10, text: str = S.CLEANED, stop_words: list[str] = (),
                  examples: int = 3) -> DataFrame:
    """Top unigrams and bigrams per group by tf * ln(rows / df), with example comments.

    One explode yields a row per occurrence, the first of each phrase in a comment marked.
    Examples are found by key; texts are fetched last, for the few chosen comments.
    """
    both = F.concat(ngrams(F.col(text), 1, stop_words), ngrams(F.col(text), 2, stop_words))

    def marks(t: Column) -> Column:
        return F.transform(t, lambda x, i: F.struct(x.alias("phrase"), ((i == 0) | (x != F.get(t, i - 1))).cast("int").alias("df")))

    counts = df.select(by, F.explode(let(F.array_sort(both), marks)).alias("m")).select(by, "m.*").groupBy(by, "phrase").agg(
        F.count("*").alias("tf"), F.sum("df").alias("df")
    )
    rows = df.groupBy(by).agg(F.count("*").alias("rows"))
    scored = counts.join(rows, by).withColumn(
        "score", F.round(F.col("tf") * F.ln(F.col("rows") / F.col("df")), 6)
    )
    top = first_rows(scored, [by], [F.desc("score"), F.col("phrase")], n).select(by, "phrase", "tf", "df", "score")
    # Used three times: written once to the checkpoint folder, n rows per group.
    checkpointing(df.sparkSession)
    top = top.checkpoint()
    # A comment's phrases are cut to the top ones of its group before they become rows.
    tops = top.groupBy(by).agg(F.collect_list("phrase").alias("_tops"))
    found = df.join(tops, by).select(by, F.col(key).alias("_key"), F.explode(F.array_intersect(both, F.col("_tops"))).alias("phrase"))
    chosen = first_rows(found, [by, "phrase"], [F.col("_key")], examples, rank="_r").join(top, [by, "phrase"])
    texts = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(chosen, "_key")
    return texts.groupBy(by, "phrase", "tf", "df", "score").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "_text"))), lambda e: e["_text"]).alias("examples")
    )
