"""Translation as a dataflow: routing, source codes, applying results, gate and fallback.

The translator itself is outside: its results arrive as a table, or a function is called
per Arrow batch through :func:`translate_with`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from talkmill import schemas as S
from talkmill.functions import flags as G
from talkmill.functions.binding import with_computed
from talkmill.functions.language import detect_script_code, language_code
from talkmill.functions.text import bigram_jaccard, clean_text, strip, word_count
from talkmill.operators.language_audit import language_distribution
from talkmill.operators.matching import replace_phrases

CODE, TRANSLATION, FAILED = "source_code", "translation", "translation_failed"
SIMILAR = 0.85
ROMANIZED = ["hinglish", "romanized_malayalam"]


def with_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({S.IS_TRANSLATED: F.lit(False), S.REMOVED_BY_TRANSLATION: F.lit(False)})


def route_non_english(df: DataFrame, language: str = S.LANGUAGE) -> DataFrame:
    """Rows to translate; a missing label counts as non-English."""
    return df.filter(F.coalesce(F.lower(F.col(language)), F.lit("")) != "english")


def resolve_source_code(df: DataFrame, key: str, text: str = S.TEXT, language: str = S.LANGUAGE) -> DataFrame:
    """Adds the translator code: by label, else by the script of the label's first text."""
    label = F.coalesce(F.lower(strip(F.col(language))), F.lit(""))
    coded = with_computed(df, {"_label": label, "_direct": language_code(label)})
    # Codes are computed row by row in the scan; only (label, id, code) reach the aggregate.
    unmapped = coded.filter(F.col("_direct").isNull() & (F.coalesce(F.col(text), F.lit("")) != ""))
    by_script = unmapped.select(
        F.col("_label").alias("_l"), F.col(key).alias("_id"), detect_script_code(F.col(text)).alias("_code")
    ).groupBy("_l").agg(F.min_by("_code", "_id").alias("_code"))
    joined = coded.join(by_script, F.col("_label") == F.col("_l"), "left")
    return joined.select(*df.columns, F.coalesce(F.col("_direct"), F.col("_code")).alias(CODE))


def apply_translations(df: DataFrame, translations: DataFrame, keys: list[str]) -> DataFrame:
    """Adds landed translations by key; rows without a result keep a null."""
    landed = translations.select(*keys, TRANSLATION)
    return df.join(landed, keys, "left")


def translate_with(df: DataFrame, translate: Callable[[list[str], str], list[str]], text: str = S.TEXT,
                   batch_size: int = 16) -> DataFrame:
    """Adds translations from a function (texts, code) -> texts, called per code and batch.

    Works on the partitions as they are, so a dominant language is spread over all tasks.
    A failing batch keeps its original texts; ``translation_failed`` marks its rows.
    """
    out = T.StructType([*df.schema, T.StructField(TRANSLATION, T.StringType()), T.StructField(FAILED, T.BooleanType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            result = pd.Series([None] * len(frame), index=frame.index, dtype=object)
            failed = pd.Series(False, index=frame.index)
            for code, part in frame[frame[CODE].notna()].groupby(CODE):
                texts = part[text].fillna("").tolist()
                done: list[str] = []
                lost: list[bool] = []
                for at in range(0, len(texts), batch_size):
                    batch = texts[at:at + batch_size]
                    try:
                        done += list(translate(batch, code))
                        lost += [False] * len(batch)
                    except Exception:  # noqa: BLE001 - any translator error falls back to the input
                        done += batch
                        lost += [True] * len(batch)
                result.loc[part.index] = done
                failed.loc[part.index] = lost
            yield frame.assign(**{TRANSLATION: result, FAILED: failed})

    return df.mapInPandas(run, out)


def gate_and_fallback(df: DataFrame, dictionary: dict[str, str] | DataFrame, text: str = S.TEXT, language: str = S.LANGUAGE,
                      key: str | None = None) -> DataFrame:
    """Decide per translated row: accept, render by dictionary, or mark as removed.

    No code or a blank result is removed; a result too similar to its input is rendered
    by dictionary for romanised languages and removed for others. The dictionary is a dict or a
    (source, english) table; a very large table also needs ``key``.
    """
    label = F.lower(strip(F.col(language)))
    result = strip(F.col(TRANSLATION))
    blank = F.col(CODE).isNull() | F.coalesce(result == "", F.lit(True))
    gated = with_computed(df, {"_same": F.when(
        ~blank, bigram_jaccard(F.coalesce(F.col(text), F.lit("")), result) > SIMILAR
    )})
    same, romanized = F.col("_same"), F.coalesce(label.isin(ROMANIZED), F.lit(False))
    # Only these texts go to the Python worker; the others are sent as null.
    rendered = replace_phrases(gated.withColumn("_romanized", F.when(same & romanized, F.col(text))), dictionary, "_romanized", "_rendered", key)
    accepted = (
        F.when(blank, F.lit(None))
        .when(same & romanized, F.col("_rendered"))
        .when(same, F.lit(None))
        .otherwise(result)
    )
    out = with_computed(rendered, {"_accepted": accepted}).drop("_romanized", "_rendered")
    out = with_computed(out, {S.CLEANED: clean_text(F.col("_accepted"))})
    return out.withColumns({
        S.IS_TRANSLATED: F.col("_accepted").isNotNull(),
        S.REMOVED_BY_TRANSLATION: G.is_empty(F.col(S.CLEANED)),
    }).drop("_same", "_accepted", CODE, TRANSLATION)


def translate_comments(df: DataFrame, translate: Callable[[DataFrame], DataFrame], dictionary: dict[str, str] | DataFrame, key: str,
                       text: str = S.TEXT, language: str = S.LANGUAGE) -> DataFrame:
    """English rows unchanged, the others translated; ``translate`` adds ``translation``."""
    flagged = with_flags(df)
    if language not in df.columns:
        return flagged
    if S.CLEANED not in df.columns:
        flagged = flagged.withColumn(S.CLEANED, F.lit(""))
    english = flagged.filter(F.coalesce(F.lower(F.col(language)), F.lit("")) == "english")
    routed = resolve_source_code(route_non_english(flagged, language), key, text, language)
    done = gate_and_fallback(translate(routed), dictionary, text, language, key)
    return english.unionByName(done.select(*flagged.columns))


def flag_final_cleanup(df: DataFrame, cleaned: str = S.CLEANED) -> DataFrame:
    flag = G.fails_final_cleanup(F.col(cleaned)) if cleaned in df.columns else F.lit(False)
    return with_computed(df, {S.REMOVED_IN_CLEANUP: flag})


def final_cleanup(df: DataFrame, cleaned: str = S.CLEANED) -> DataFrame:
    """Rows that still carry enough text after translation."""
    return flag_final_cleanup(df, cleaned).filter(~F.col(S.REMOVED_IN_CLEANUP))


def translation_columns(df: DataFrame) -> list[Column]:
    """Total, translated and removed rows, as aggregates."""
    def count(c: str) -> Column:
        return F.count_if(F.col(c)) if c in df.columns else F.lit(0).cast("bigint")

    return [
        F.count("*").alias("total_comments"), count(S.IS_TRANSLATED).alias("translated_comments"),
        count(S.REMOVED_BY_TRANSLATION).alias("removed_by_translation_failure"),
    ]


def translation_report(df: DataFrame) -> DataFrame:
    """Total, translated and removed rows (one row)."""
    return df.agg(*translation_columns(df))


def translated_by_language(df: DataFrame, language: str = S.LANGUAGE) -> DataFrame:
    return df.filter(F.col(S.IS_TRANSLATED) & F.col(language).isNotNull()).groupBy(language).agg(F.count("*").alias("n"))


def readiness_columns(flagged: DataFrame, cleaned: str = S.CLEANED, language: str = S.LANGUAGE) -> list[Column]:
    """Counts before and after final cleanup, as aggregates over a table with its flag."""
    kept = ~F.col(S.REMOVED_IN_CLEANUP)
    removed = F.col(S.REMOVED_BY_TRANSLATION)
    return [
        F.count("*").alias("rows_before_cleanup"), F.count_if(kept).alias("rows_after_cleanup"),
        F.count_if(~kept).alias("rows_removed"),
        F.count_if(removed).alias("removed_by_translation_failure"),
        F.count_if(~kept & ~removed).alias("removed_by_final_cleanup"),
        F.bool_and(F.when(kept, F.coalesce(F.lower(F.col(language)) == "english", F.lit(False)))).alias("all_comments_english"),
        F.min(F.when(kept, F.length(cleaned))).alias("minimum_cleaned_length_chars"),
        F.min(F.when(kept, word_count(F.col(cleaned)))).alias("minimum_cleaned_word_count"),
    ]


def judged_readiness(counts: DataFrame) -> DataFrame:
    return counts.withColumn("annotation_readiness", F.when(F.col("rows_after_cleanup") > 0, "READY").otherwise("EMPTY_DATASET"))


def readiness_report(df: DataFrame, cleaned: str = S.CLEANED, language: str = S.LANGUAGE) -> DataFrame:
    """Counts before and after final cleanup, from the translated table in one pass."""
    flagged = flag_final_cleanup(df, cleaned)
    return judged_readiness(flagged.agg(*readiness_columns(flagged, cleaned, language)))


def language_after_cleanup(df: DataFrame) -> DataFrame:
    return language_distribution(final_cleanup(df))
