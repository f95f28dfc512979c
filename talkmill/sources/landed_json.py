"""Landed API responses (one JSON document per row) as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talkmill import schemas as S
from talkmill.functions.labels import safe_long
from talkmill.functions.text import strip, watch_url
from talkmill.operators.conform import ensure_columns
from talkmill.operators.dedup import keep_first
from talkmill.operators.ranking import first_rows

_SEARCH = """items array<struct<id struct<videoId string>, snippet struct<title string,
 description string, channelTitle string, channelId string, publishedAt string>>>"""
_VIDEOS = """items array<struct<id string, snippet struct<title string, channelTitle string,
 publishedAt string, tags array<string>, categoryId string>, statistics struct<viewCount string,
 likeCount string, commentCount string>, contentDetails struct<duration string>>>"""
_THREADS = """items array<struct<snippet struct<videoId string, topLevelComment struct<id string,
 snippet struct<videoId string, authorDisplayName string, textDisplay string, likeCount string,
 publishedAt string, updatedAt string>>>>>"""


def _clean_query(product: str | Column) -> Column:
    if isinstance(product, str):
        if not product.strip():
            raise ValueError("the product query is blank")
        return F.lit(product.strip())
    return strip(product)


def _items(raw: DataFrame, body: str, schema: str, keep: dict[str, Column]) -> DataFrame:
    """One row per item of the response, with its position."""
    parsed = raw.select(*[c.alias(n) for n, c in keep.items()], F.from_json(F.col(body), schema).alias("r"))
    return parsed.select(*keep, F.posexplode("r.items").alias("position", "item"))


def present(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def flatten_search(raw: DataFrame, product: str | Column, body: str = "body") -> DataFrame:
    """Search results that carry a video id."""
    items = _items(raw, body, _SEARCH, {"product_query": _clean_query(product)})
    s, vid = F.col("item.snippet"), F.col("item.id.videoId")
    rows = items.filter(present(vid)).select(
        "product_query", vid.alias("video_id"), watch_url(vid).alias("video_url"), s["title"].alias("title"),
        s["description"].alias("description"), s["channelTitle"].alias("channel_name"),
        s["channelId"].alias("channel_id"), s["publishedAt"].alias("published_at"),
    )
    return ensure_columns(rows, S.VIDEO_SEARCH)


def flatten_videos(raw: DataFrame, product: str | Column, body: str = "body", page: str | None = None) -> DataFrame:
    """Video metadata; one row per id, the first in page and item order."""
    order = F.col(page) if page else F.lit(0)
    items = _items(raw, body, _VIDEOS, {"product_query": _clean_query(product), "page": order})
    s, n, vid = F.col("item.snippet"), F.col("item.statistics"), F.col("item.id")
    rows = items.filter(present(vid)).select(
        vid.alias("video_id"), "product_query", s["title"].alias("title"), watch_url(vid).alias("video_url"),
        s["channelTitle"].alias("channel_name"), s["publishedAt"].alias("published_at"),
        safe_long(n["viewCount"]).alias("view_count"), safe_long(n["likeCount"]).alias("like_count"),
        safe_long(n["commentCount"]).alias("comment_count"), F.col("item.contentDetails.duration").alias("duration"),
        F.coalesce(s["tags"], F.array().cast("array<string>")).alias("tags"), s["categoryId"].alias("category_id"),
        "page", "position",
    )
    return ensure_columns(keep_first(rows, "video_id", [F.col("page"), F.col("position")]), S.VIDEOS)


def flatten_comments(raw: DataFrame, product: str | Column, body: str = "body", page: str | None = None,
                     per_video: int | None = None, video: Column | None = None, title: Column | None = None,
                     url: Column | None = None) -> DataFrame:
    """Top-level comments with an id: all that have landed, or the first ``per_video`` of each video.

    Without ``page`` the first ones are told by item position, then by comment id.
    """
    if per_video is not None and per_video < 1:
        raise ValueError("a cap of comments per video has to be positive")
    null = F.lit(None).cast("string")
    items = _items(raw, body, _THREADS, {
        "product_query": _clean_query(product), "page": F.col(page) if page else F.lit(0),
        "row_video": null if video is None else video, "video_title": null if title is None else title,
        "row_url": null if url is None else url,
    })
    top = F.col("item.snippet.topLevelComment")
    vid = F.coalesce(F.col("row_video"), F.col("item.snippet.videoId"), top["snippet"]["videoId"])
    s = top["snippet"]
    rows = items.filter(present(top["id"])).select(
        "product_query", vid.alias("video_id"),
        F.coalesce(F.nullif("row_url", F.lit("")), watch_url(vid)).alias("video_url"), "video_title",
        top["id"].alias("comment_id"), s["authorDisplayName"].alias("author_name"), s["textDisplay"].alias("comment_text"),
        safe_long(s["likeCount"]).alias("like_count"), s["publishedAt"].alias("published_at"),
        s["updatedAt"].alias("updated_at"), "page", "position",
    ).filter(present(F.col("video_id")))
    if per_video is not None:
        rows = cap_per_video(rows, [F.col("page"), F.col("position"), F.col("comment_id")], per_video)
    return ensure_columns(rows, S.COMMENTS)


def cap_per_video(df: DataFrame, order: list[Column], n: int = 100, video: str = "video_id") -> DataFrame:
    """At most ``n`` comments per video."""
    return first_rows(df, [video], order, n)
