"""Label statistics of annotated comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from talkmill.functions.labels import is_filled, percent
from talkmill.functions.lexicons import ASPECT_LABELS
from talkmill.functions.text import preview, strip
from talkmill.operators.ranking import stack_columns


def label_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per trimmed non-blank label."""
    return df.filter(is_filled(F.col(column))).groupBy(strip(F.col(column)).alias("label")).agg(F.count("*").alias("n"))


def annotation_report(df: DataFrame) -> DataFrame:
    """Totals, fully labelled rows and missing labels (one row)."""
    def filled(c: str) -> Column:
        return is_filled(F.col(c)) if c in df.columns else F.lit(False)

    s, a = filled("sentiment_label"), filled("aspect_label")
    return df.agg(
        F.count("*").alias("total_rows"), F.count_if(s & a).alias("labeled_rows"),
        F.count_if(~s).alias("missing_sentiment_labels"), F.count_if(~a).alias("missing_aspect_labels"),
    )


def annotation_overview(df: DataFrame, labels: list[str]) -> DataFrame:
    """Rows, distinct products and non-null counts per label column."""
    return df.agg(
        F.count("*").alias("total_rows"), F.count_distinct("product_query").alias("products"),
        *[F.count(c).alias(f"{c}_filled") for c in labels],
    )


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``column`` values per ``row`` value; one hash aggregate, no pivot job."""
    cells = [F.count_if(F.col(column) == v).alias(v.lower().replace(" ", "_")) for v in values]
    return df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row).agg(*cells)


def aspect_quality(df: DataFrame, digits: int | None = 1) -> DataFrame:
    """Per aspect: rows, rows with notes, translated rows and their shares."""
    grouped = df.filter(F.col("aspect_label").isNotNull()).groupBy("aspect_label").agg(
        F.count("*").alias("n"), F.count("review_notes").alias("has_notes"),
        F.count_if(F.coalesce(F.col("is_translated"), F.lit(False))).alias("is_translated"),
    )
    return grouped.withColumns({
        "notes_ratio": percent(F.col("has_notes"), F.col("n"), digits),
        "translated_ratio": percent(F.col("is_translated"), F.col("n"), digits),
    })


def class_buckets(df: DataFrame, label: str, rare: int = 10, low: int = 20) -> DataFrame:
    """Size class, imbalance (largest class / class) and share of every label."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # one row per label
    bucket = F.when(F.col("n") <= rare, "rare").when(F.col("n") <= low, "low").otherwise("adequate")
    return counts.withColumns({
        "bucket": bucket,
        "imbalance": F.max("n").over(everything) / F.col("n"),
        "pct": F.col("n") / F.sum("n").over(everything) * 100,
    })


def class_distribution(df: DataFrame, label: str, labels: list[str] = ASPECT_LABELS) -> DataFrame:
    """Rows and share of every listed label, zero classes included."""
    total = F.count("*")
    counted = df.agg(total.alias("_rows"), *[F.count_if(F.col(label) == v).alias(f"_{i}") for i, v in enumerate(labels)])
    rows = stack_columns(counted, {f"_{i}": v for i, v in enumerate(labels)}, "label", "n", ["_rows"])
    return rows.select("label", "n", percent(F.col("n"), F.col("_rows"), None).alias("pct"))


def consistency_checks(df: DataFrame) -> DataFrame:
    """Rows per note, and how many carry the label expected for that note."""
    question, unrelated = F.col("review_notes") == "Question", F.col("review_notes") == "Unrelated"
    neutral = F.coalesce(F.col("sentiment_label") == "Neutral", F.lit(False))
    off_topic = F.coalesce(F.col("aspect_label").isin("Other", "Spam"), F.lit(False))
    counted = df.agg(
        F.count_if(question).alias("question_rows"), F.count_if(question & neutral).alias("question_neutral"),
        F.count_if(unrelated).alias("unrelated_rows"), F.count_if(unrelated & off_topic).alias("unrelated_other_spam"),
    )
    return counted.withColumns({
        "question_neutral_pct": percent(F.col("question_neutral"), F.col("question_rows"), None),
        "unrelated_other_spam_pct": percent(F.col("unrelated_other_spam"), F.col("unrelated_rows"), None),
    })


def note_distribution(df: DataFrame, label: str) -> DataFrame:
    """Label counts given the note."""
    return df.dropna(subset=["review_notes", label]).groupBy("review_notes", label).agg(F.count("*").alias("n"))


def flag_mismatch(df: DataFrame) -> DataFrame:
    """Agreement of the Spam label with the pipeline flags (one row)."""
    labelled = F.coalesce(F.col("aspect_label") == "Spam", F.lit(False))
    def flag(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False))

    return df.agg(
        F.count_if(labelled).alias("labeled_spam"), F.count_if(flag("is_spam")).alias("flagged_spam"),
        F.count_if(labelled & flag("is_spam")).alias("both"),
        F.count_if(labelled & ~flag("is_spam")).alias("label_only"),
        F.count_if(~labelled & flag("is_spam")).alias("flag_only"),
        F.count_if(labelled & flag("is_short_comment")).alias("short_and_labeled"),
        F.count_if(labelled & flag("is_single_word")).alias("single_word_and_labeled"),
    )


def spam_sets(df: DataFrame) -> DataFrame:
    """Rows where label or flag says spam, with the kind of agreement."""
    labelled = F.coalesce(F.col("aspect_label") == "Spam", F.lit(False))
    flagged = F.coalesce(F.col("is_spam"), F.lit(False))
    kind = F.when(labelled & flagged, "hit").when(labelled, "miss").otherwise("false_positive")
    return df.filter(labelled | flagged).withColumn("agreement", kind)


def review_table(df: DataFrame, keep: list[str], texts: dict[str, int]) -> DataFrame:
    """Columns for manual review with texts cut to a preview length."""
    return df.select(*keep, *[preview(F.col(c), n).alias(c) for c, n in texts.items()])


def product_stats(df: DataFrame) -> DataFrame:
    """Comments, spam, translated and short rows per product."""
    return df.filter(F.col("product_query").isNotNull()).groupBy("product_query").agg(
        F.count("comment_id").alias("comments"), F.count_if(F.col("is_spam")).alias("spam"),
        F.count_if(F.col("is_translated")).alias("translated"), F.count_if(F.col("is_short_comment")).alias("short"),
    )


def dataset_kpis(master: DataFrame, annotations: DataFrame) -> DataFrame:
    """Headline numbers (one row)."""
    return master.agg(
        F.count("*").alias("total_comments"), F.count_distinct("product_query").alias("products"),
        F.count_if(F.col("is_spam")).alias("spam_flagged"), F.count_if(F.col("is_translated")).alias("translated"),
    ).withColumn("annotated", annotations.agg(F.count("*")).scalar())
