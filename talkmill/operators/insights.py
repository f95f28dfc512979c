"""Per-product consumer insights, all products in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from talkmill import schemas as S
from talkmill.functions.binding import let, with_computed
from talkmill.functions.competitors import extract_competitors
from talkmill.functions.lexicons import SENTIMENT_LABELS
from talkmill.functions.labels import percent
from talkmill.functions.sentiment import compound_label, rule_sentiment
from talkmill.functions.text import preview
from talkmill.operators.matching import SET_BYTES
from talkmill.operators.ranking import first_rows, first_texts
from talkmill.operators.terms import tokens
from talkmill.session import written

PREDICTED = "predicted_sentiment"


def add_rule_sentiment(df: DataFrame, text: str = S.CLEANED, out: str = PREDICTED) -> DataFrame:
    return with_computed(df, {out: rule_sentiment(F.col(text))})


def lexicon_compound(df: DataFrame, valence: DataFrame, key: str, text: str = S.CLEANED, set_bytes: int = SET_BYTES) -> DataFrame:
    """(key, valence_sum, compound, label) from a user-supplied (token, valence) table.

    The compound is s / sqrt(s * s + 15); rows without a hit are Neutral. Tokens of the lexicon are
    expected to be unique; of repeated ones the valences add up. The tokens of the texts are never sorted:
    a small lexicon is sent to them whole, of a larger one each task holds its part of the lexicon only.
    """
    weights = valence.where("token IS NOT NULL AND valence IS NOT NULL").groupBy(F.col("token").alias("_t")).agg(F.sum(F.col("valence").cast("double")).alias("_v"))
    weights = written(weights, "lexicon")
    size = weights.agg(F.sum(F.octet_length("_t") + 24)).first()[0] or 0
    found = df.select(key, F.explode_outer(tokens(F.col(text))).alias("_token"))
    hits = found.join(weights.hint("broadcast" if size <= set_bytes else "shuffle_hash"), F.col("_token") == F.col("_t"), "left")
    summed = hits.groupBy(key).agg(F.sum("_v").alias("_s"))
    total = F.coalesce(F.col("_s"), F.lit(0.0))
    compound = total / F.sqrt(total * total + F.lit(15.0))
    return summed.select(key, total.alias("valence_sum"), compound.alias("compound"), compound_label(compound).alias("label"))


def sentiment_distribution(df: DataFrame, product: str = S.PRODUCT, sentiment: str = PREDICTED, digits: int | None = 1) -> DataFrame:
    """Count and share of every sentiment per product."""
    counts = df.groupBy(product, sentiment).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(product))
    return counts.withColumn("pct", percent(F.col("n"), total, digits))


def competitor_mentions(df: DataFrame, product: str = S.PRODUCT, text: str = S.CLEANED, n: int | None = 10, **kwargs) -> DataFrame:
    """Comments that mention each competitor, per product, top ``n``."""
    names = extract_competitors(F.col(text), F.col(product), **kwargs)
    counts = df.select(product, F.explode(names).alias("competitor")).groupBy(product, "competitor").agg(
        F.count("*").alias("mentions")
    )
    return counts if n is None else first_rows(counts, [product], [F.desc("mentions"), F.col("competitor")], n)


def keyword_join(df: DataFrame, keywords: list[str], key: str, text: str = S.CLEANED) -> DataFrame:
    """(key, keyword) for every keyword contained in a text, without a nested-loop join."""
    hits = let(F.lower(F.col(text)), lambda low: F.array_compact(F.array(*[
        F.when(low.contains(k.lower()), F.lit(k)) for k in keywords
    ])))
    return df.select(key, F.explode(hits).alias("keyword"))


def sample_comments(df: DataFrame, order: str, group: list[str] = (S.PRODUCT, PREDICTED), text: str = S.CLEANED,
                    n: int = 5, two_pass: bool = False) -> DataFrame:
    """First ``n`` comments per group as rows."""
    return first_texts(df.filter(F.col(text).isNotNull()), list(group), order, text, n, "example_rank", two_pass)


def product_insights(df: DataFrame, key: str = "comment_id", product: str = S.PRODUCT, text: str = S.CLEANED,
                     two_pass: bool = False) -> DataFrame:
    """One row per product: totals, sentiment map, top competitors and example comments.

    Collected values are bounded: 3 sentiments, 10 competitors, 5 examples per sentiment. Every
    sentiment has an entry in ``sample_comments``, without comments an empty list.
    """
    scored = df if PREDICTED in df.columns else add_rule_sentiment(df, text)
    dist = sentiment_distribution(scored, product).groupBy(product).agg(
        F.sum("n").alias("total_comments"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct(F.lower(PREDICTED).alias("k"), F.struct(F.col("n").alias("count"), "pct").alias("v"))
        ))).alias("sentiment_distribution"),
    )
    rivals = competitor_mentions(df, product, text).groupBy(product).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("mentions")).alias("m"), "competitor"))),
            lambda r: F.struct(r["competitor"].alias("competitor"), (-r["m"]).alias("mentions")),
        ).alias("competitor_mentions")
    )
    per_sentiment = sample_comments(scored, key, [product, PREDICTED], text, two_pass=two_pass).groupBy(product, PREDICTED).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("example_rank", text))), lambda e: e[text]).alias("texts")
    )
    shown = per_sentiment.groupBy(product).agg(
        F.map_from_entries(F.collect_list(F.struct(F.lower(PREDICTED).alias("k"), "texts"))).alias("_shown")
    )
    none = F.array().cast("array<string>")
    labels = sorted(s.lower() for s in SENTIMENT_LABELS)
    samples = F.create_map(*[x for s in labels for x in (F.lit(s), F.coalesce(F.col("_shown")[s], none))])
    joined = dist.join(rivals, product, "left").join(shown, product, "left").withColumn("sample_comments", samples)
    return joined.drop("_shown").withColumnRenamed(product, "product")


def insight_summary(df: DataFrame, product: str = S.PRODUCT, text: str = S.CLEANED) -> DataFrame:
    """Cross-product summary: totals, positive and negative share, top competitor."""
    scored = df if PREDICTED in df.columns else add_rule_sentiment(df, text)
    def count(label: str) -> Column:
        return F.count_if(F.col(PREDICTED) == label)

    totals = scored.groupBy(product).agg(
        F.count("*").alias("total_comments"), count("Positive").alias("positive"), count("Negative").alias("negative")
    )
    top = competitor_mentions(df, product, text, 1)
    return totals.join(top, product, "left").withColumns({
        "positive_pct": percent(F.col("positive"), F.col("total_comments"), 1),
        "negative_pct": percent(F.col("negative"), F.col("total_comments"), 1),
    })


# --- aspect views -------------------------------------------------------------

def aspect_distribution(df: DataFrame, aspect: str, by: str = S.PRODUCT, n: int = 8, hidden: str = "Spam") -> DataFrame:
    """Share of all comments per aspect: the ``n`` largest, the hidden label left out."""
    counts = df.groupBy(by, aspect).agg(F.count("*").alias("mentions"))
    shared = counts.withColumn("pct", percent(F.col("mentions"), F.sum("mentions").over(Window.partitionBy(by)), None))
    return first_rows(shared, [by], [F.desc("mentions"), F.col(aspect)], n).filter(F.col(aspect) != hidden)


def aspect_sentiment_matrix(df: DataFrame, aspect: str, sentiment: str = PREDICTED, by: str | None = None) -> DataFrame:
    cells = [F.count_if(F.col(sentiment) == s).alias(s.lower()) for s in SENTIMENT_LABELS]
    return df.groupBy(*([by] if by else []), aspect).agg(*cells)


def top_aspects(df: DataFrame, aspect: str, label: str, sentiment: str = PREDICTED, by: str = S.PRODUCT, n: int = 5) -> DataFrame:
    """Aspects with the highest share of one sentiment within the aspect."""
    counts = df.groupBy(by, aspect).agg(F.count("*").alias("mentions"), F.count_if(F.col(sentiment) == label).alias("hits"))
    shared = counts.withColumn("pct", percent(F.col("hits"), F.col("mentions"), None))
    return first_rows(shared, [by], [F.desc("pct"), F.col(aspect)], n)


def top_comments_by_aspect(df: DataFrame, aspect: str, order: str, sentiment: str = PREDICTED, text: str = S.CLEANED,
                           by: str = S.PRODUCT, n: int = 2, width: int = 150) -> DataFrame:
    """Example comments per aspect for positive and negative sentiment."""
    rows = df.filter(F.col(sentiment).isin("Positive", "Negative")).select(
        by, aspect, sentiment, order, preview(F.col(text), width).alias(text)
    )
    return first_rows(rows, [by, aspect, sentiment], [F.col(order)], n, rank="example_rank")
