"""Lexicon sentiment without a UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from talkmill.functions import lexicons as X, patterns as P

# A whole word run that consists of a-z only.
TOKEN = rf"(?<![{P.WORD}])[a-z]+(?![{P.WORD}])"


def sentiment_score(
    c: Column,
    positive: list[str] = X.POSITIVE_WORDS,
    negative: list[str] = X.NEGATIVE_WORDS,
    intensifiers: list[str] = X.INTENSIFIERS,
    negators: list[str] = X.NEGATORS,
) -> Column:
    """Sum of +1/-1 words; the token before a word may double or flip it."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)
    # A fold that carries the effect of the previous token: one pass over one array.
    start = F.struct(F.lit(0).cast("bigint").alias("score"), F.lit(1).alias("factor"))

    every = sorted({*positive, *negative, *intensifiers, *negators})

    def step(acc: Column, t: Column) -> Column:
        value = F.when(t.isin(positive), 1).when(t.isin(negative), -1).otherwise(0)
        factor = F.when(t.isin(intensifiers), 2).when(t.isin(negators), -1).otherwise(1)
        found = F.struct((acc["score"] + value * acc["factor"]).alias("score"), factor.alias("factor"))
        # Nearly all tokens are in no list: one hash probe settles them.
        return F.when(t.isin(every), found).otherwise(F.struct(acc["score"], F.lit(1).alias("factor")))

    return F.coalesce(F.aggregate(tokens, start, step, lambda acc: acc["score"]), F.lit(0).cast("bigint"))


def sentiment_label(score: Column) -> Column:
    return (
        F.when(score > 0, F.lit("Positive")).when(score < 0, F.lit("Negative")).otherwise(F.lit("Neutral"))
    )


def rule_sentiment(c: Column) -> Column:
    return sentiment_label(sentiment_score(c))


def compound_label(compound: Column, threshold: float = 0.05) -> Column:
    return (
        F.when(compound >= threshold, F.lit("Positive"))
        .when(compound <= -threshold, F.lit("Negative"))
        .otherwise(F.lit("Neutral"))
    )
