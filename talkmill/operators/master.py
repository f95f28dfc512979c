"""Comments joined to video metadata: the master table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from talkmill import schemas as S
from talkmill.operators.conform import ensure_columns, prepare_videos, rename_comment_columns
from talkmill.operators.dedup import keep_first, removed_count

# File and row a record was read from, as sources.files adds them.
PROVENANCE = ["source_file", "source_row"]
# The video's value wins over the comment's for these columns.
COALESCED = ["product_query", "video_title", "video_url", "published_at"]


def left_join_unique(left: DataFrame, right: DataFrame, key: str, salts: int = 1, salt_on: str = "comment_id") -> DataFrame:
    """Left outer join to a table with one row per key; right columns get the prefix ``_r_``.

    No broadcast hint: Spark broadcasts the right side only when its measured size is
    below the threshold, and AQE splits hot keys of a shuffle join. ``salts`` > 1 spreads
    every key over that many partitions, chosen by a hash of the row id ``salt_on``, and
    repeats the (unique-key) right side as often.
    """
    prefixed = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
    if salts <= 1:
        return left.join(prefixed, F.col(key) == F.col(f"_r_{key}"), "left")
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int"))
    copies = prefixed.withColumn("_r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = (F.col(key) == F.col(f"_r_{key}")) & (F.col("_salt") == F.col("_r_salt"))
    return salted.join(copies, same, "left").drop("_salt", "_r_salt")


def coalesce_joined(joined: DataFrame, left_columns: list[str], right_columns: list[str], key: str) -> DataFrame:
    """Resolve columns that both sides have: right value first for COALESCED, else left."""
    out = []
    for c in left_columns:
        both = c in right_columns and c != key
        if both and c in COALESCED:
            out.append(F.coalesce(F.col(f"_r_{c}"), F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    out += [F.col(f"_r_{c}").alias(c) for c in right_columns if c not in left_columns and c != key]
    return joined.select(*out)


def build_master(videos: DataFrame, comments: DataFrame, salts: int = 1, video_order: list[str] | None = None,
                 keep_provenance: bool = False) -> DataFrame:
    """Processed comments with video metadata in the fixed master columns.

    ``keep_provenance`` lets the file and row of a comment through, for duplicate removal in file order.
    """
    left = rename_comment_columns(comments)
    right = prepare_videos(videos, video_order)
    if "video_id" in right.columns and "video_id" in left.columns:
        joined = left_join_unique(left, right, "video_id", salts)
        left = coalesce_joined(joined, left.columns, right.columns, "video_id")
    extra = [f for f in left.schema if keep_provenance and f.name in PROVENANCE]
    return ensure_columns(left, T.StructType([*S.MASTER, *extra]))


def remove_duplicate_comments(master: DataFrame, order: list | None = None) -> DataFrame:
    """One row per comment_id, the first in ``order``: by default in file order, where it is known.

    Without it, equal ids are told apart by their values, so the survivor is defined as well.
    """
    known = [c for c in PROVENANCE if c in master.columns]
    columns = order or [F.col(c) for c in known or ("video_id", "comment_text", "updated_at") if c in master.columns]
    return keep_first(master, "comment_id", columns).drop(*PROVENANCE)


def count_files(df: DataFrame) -> int:
    """Files a table was read from; 1 for a table whose rows don't say."""
    if "source_file" not in df.columns:
        return 1
    return df.agg(F.count_distinct(F.nullif("source_file", F.lit("")))).first()[0]


def products(df: DataFrame, column: str = "product_query") -> DataFrame:
    """Sorted distinct product names, one per row."""
    return df.select(F.col(column).cast("string").alias(column)).dropna().distinct().orderBy(column)


def master_report(
    master: DataFrame, videos: DataFrame, video_files: int, comment_files: int, source: DataFrame | None = None,
    counted: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """One row of export counts; ``source`` is the table before duplicate removal.

    ``counted`` gives rows (n) before and after it where they are known already. The product names
    themselves are a table of their own: :func:`products`.
    """
    total_videos = (
        videos.agg(F.count_distinct("video_id")) if "video_id" in videos.columns
        else videos.limit(1).agg(F.lit(0).cast("bigint"))
    )
    if counted is None:
        removed, total = removed_count(master if source is None else source, "comment_id"), master.agg(F.count("*").alias("total_comments"))
    else:
        before, after = counted
        removed, total = before.select(F.col("n") - after.select("n").scalar()), after.select(F.col("n").alias("total_comments"))
    product_count = (
        master.select("product_query").dropna().distinct().agg(F.count("*"))
        if "product_query" in master.columns else master.limit(1).agg(F.lit(0).cast("bigint"))
    )
    return total.select(
        product_count.scalar().alias("product_count"),
        F.lit(video_files).alias("video_files_found"),
        F.lit(comment_files).alias("comment_files_found"),
        "total_comments",
        total_videos.scalar().alias("total_videos"),
        removed.scalar().alias("duplicate_comments_removed"),
    )
