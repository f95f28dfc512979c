"""Cleaning, thinning, mixing and packing a corpus; each stage reads all the one before has kept.

Stages take (spark, docs, sf_dir) and return documents with their columns; the last returns the
packing plan. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkmill.llm import fertility, length_packing, line_dedup, mixing, near_copies, simhash_pivots
from talkmill.llm.common import free_name, same, staged, table
from talkmill.llm.queries import PIECES, RANKS

#: Wanted shares of expected tokens. Rates stay at or below 1, so clean documents are not repeated.
MIX = {"clean": 1.0, "toxic": 0.0}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and the fertility bands.

    Null and empty texts have too few words and go. Rows that repeat an id or a text are judged each by
    its own text, so equal rows stay or go together; extra columns are kept; an empty table stays empty.
    """
    id_, hash_ = (free_name(docs.columns, c) for c in ("id", "hash"))
    kept = fertility.judged(docs, PIECES, RANKS).filter("kept").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    return docs.join(kept, same([F.col("doc_id"), fertility.text_hash(F.col("text"))], [F.col(id_), F.col(hash_)]), "left_semi")


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier one; those left without a word go.

    Null and blank texts have no lines and stay as they are. Rows equal in id and text lose the same
    lines, rows that share only the id are documents of their own; an empty table stays empty.
    """
    return line_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8 or more, verified.

    Candidates are fingerprints linked through pivot tables and, for pairs further apart, MinHash bands.
    Equal texts are copies, and so are all texts without a word, null ones among them. The smallest id
    of a group stays, with all rows that have this id; rows without an id stay only where no member has
    one. Extra columns are kept; an empty table stays empty.
    """
    return simhash_pivots.one_of_each(docs, grouped=near_copies.near_copy_groups)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by rates whose expected tokens match MIX; toxic ones fade out.

    A null or empty text has no words, one token and the prior of the labels. Rows equal in id and text
    are drawn together. Without labels all posteriors are priors; an empty table stays empty.
    """
    domains = {"toxic": F.col("toxic") == 1, "clean": F.col("toxic") == 0}
    rates, _ = mixing.soft_mixture(docs, table(spark, sf_dir, "labels"), MIX, top=1.0, domains=domains)
    return mixing.drawn(docs, rates)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in length buckets and batches.

    Null counts as the empty text; every row is packed, also repeated ones; an empty table gives no pieces.
    """
    return length_packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_repeats), ("simhash_near_dedup", near_duplicates), ("mixing", mixture), ("packing", packing),
]

#: Fingerprints and the fitted classifier can't be written in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each does with nulls, copies and nothing, its docstring says."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
