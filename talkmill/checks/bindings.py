"""Comment, video and annotation tables derived from the given tables, in Spark and in SQL.

Every document becomes a comment. Its text is kept whole and a remark is appended that
exercises a branch (links, markers, scripts, lexicon words). Short and blank comments do not
occur otherwise: some documents give a second comment that is a remark only.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkmill.functions.flags import is_short, is_single_word, is_spam
from talkmill.functions.lexicons import ASPECT_LABELS
from talkmill.session import tune

# (a comment of its own?, remark)
REMARKS: list[tuple[bool, str | None]] = [
    (False, "Really good camera but the battery is not great."),
    (False, "Worst purchase, very bad screen and too expensive!!!"),
    (False, "The ROG Ally and PS5 beat the steam deck, xbox too"),
    (False, "bhai camera bahut accha hai"),
    (False, "यह फोन अच्छा है"),
    (False, "நல்லது ఈ ఈ phone"),
    (False, "<b>I love it</b>???"),
    (False, "see https://a.example/x?y=1 and www.b.example/z"),
    (False, "www.only.example/page"),
    (False, "subscribe for a giveaway"),
    (True, ""),
    (True, "   "),
    (True, "[Deleted] "),
    (True, "ok"),
    (True, "🔥🔥🔥"),
    (True, "Switch"),
    (False, "plz dedo"),
    (False, "sooooooo good"),
    (False, "this chetta is nalla"),
    (False, "Samsung galaxy or pixel?, never bad; no problem...."),
    (True, None),
    (False, "привет мир как дела"),
    (False, "I love the display"),
]
SLOTS = len(REMARKS)
ALONE = [i for i, (whole, _) in enumerate(REMARKS) if whole]
PRODUCT_NAMES = {"src0": "Steam Deck", "src1": "Nintendo Switch", "src2": "Iphone 17"}
NOTES = ["ambiguous", " future demand", "Language Error", "question ", "unrelated", "", None]
PER_VIDEO = 10  # documents per video, so the number of videos grows with the data


def lit(text: str | None) -> str:
    """SQL string literal."""
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def lits(texts: list[str | None]) -> str:
    return ", ".join(lit(t) for t in texts)


_PRODUCT_CASE = "CASE source " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in PRODUCT_NAMES.items()) + " ELSE source END"

COMMENTS_SQL = f"""comments AS (
  SELECT doc_id, 'c' || doc_id AS comment_id, 'v' || (doc_id // {PER_VIDEO}) AS video_id,
    {_PRODUCT_CASE} AS product_query,
    CASE WHEN doc_id % {SLOTS} IN ({', '.join(map(str, ALONE))}) THEN text
         ELSE text || ' ' || [{lits([r for _, r in REMARKS])}][doc_id % {SLOTS} + 1] END AS comment_text,
    n_chars % 50 AS like_count, lang, text, n_chars
  FROM documents
  UNION ALL
  SELECT -1 - doc_id, 'x' || doc_id, 'v' || (doc_id // {PER_VIDEO}), {_PRODUCT_CASE}, [{lits([r for _, r in REMARKS])}][doc_id % {SLOTS} + 1],
    n_chars % 50, lang, text, n_chars
  FROM documents WHERE doc_id % {SLOTS} IN ({', '.join(map(str, ALONE))}))"""

ANNOTATED_SQL = f"""annotated AS (
  SELECT c.*, l.quality, l.toxic,
    CASE WHEN n_chars % 7 = 0 THEN ' ' WHEN n_chars % 13 = 0 THEN NULL WHEN toxic = 1 THEN ' negative'
         WHEN quality = 1 THEN 'Positive' ELSE 'neutral' END AS sentiment_label,
    CASE WHEN n_chars % 11 = 0 THEN NULL WHEN n_chars % 17 = 0 THEN '' WHEN toxic = 1 THEN 'Spam'
         ELSE [{lits(ASPECT_LABELS)}][n_chars % {len(ASPECT_LABELS)} + 1] END AS aspect_label,
    [{lits(NOTES)}][n_chars % {len(NOTES)} + 1] AS review_notes,
    lang <> 'en' AS is_translated
  FROM comments c JOIN labels l USING (doc_id))"""


def _pick(values: list[str | None], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (at + 1).cast("int"))


class Tables:
    """The given tables of one folder and the tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = tune(spark), sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def comments(self) -> DataFrame:
        return comments_of(self.documents)

    @cached_property
    def annotated(self) -> DataFrame:
        n = F.col("n_chars")
        sentiment = (
            F.when(n % 7 == 0, F.lit(" ")).when(n % 13 == 0, F.lit(None)).when(F.col("toxic") == 1, F.lit(" negative"))
            .when(F.col("quality") == 1, F.lit("Positive")).otherwise(F.lit("neutral"))
        )
        aspect = (
            F.when(n % 11 == 0, F.lit(None)).when(n % 17 == 0, F.lit("")).when(F.col("toxic") == 1, F.lit("Spam"))
            .otherwise(_pick(ASPECT_LABELS, n % len(ASPECT_LABELS)))
        )
        return self.comments.join(self.labels, "doc_id").withColumns({
            "sentiment_label": sentiment, "aspect_label": aspect,
            "review_notes": _pick(NOTES, n % len(NOTES)), "is_translated": F.col("lang") != "en",
        })

    @cached_property
    def flagged_annotations(self) -> DataFrame:
        text = F.col("comment_text")
        return self.annotated.withColumns({
            "is_spam": is_spam(text), "is_short_comment": is_short(text), "is_single_word": is_single_word(text),
        })


def comments_of(documents: DataFrame) -> DataFrame:
    """The comment binding; row-wise, so it also works on a stream."""
    slot = F.col("doc_id") % SLOTS
    remark = _pick([r for _, r in REMARKS], slot)
    product = F.coalesce(
        *[F.when(F.col("source") == k, F.lit(v)) for k, v in PRODUCT_NAMES.items()], F.col("source")
    )

    def rows(docs: DataFrame, id_: Column, mark: str, text: Column) -> DataFrame:
        return docs.select(
            id_.alias("doc_id"), F.concat(F.lit(mark), F.col("doc_id").cast("string")).alias("comment_id"),
            F.concat(F.lit("v"), F.expr(f"cast(doc_id div {PER_VIDEO} as string)")).alias("video_id"), product.alias("product_query"),
            text.alias("comment_text"), (F.col("n_chars") % 50).alias("like_count"), "lang", "text", "n_chars",
        )

    with_remark = F.when(slot.isin(ALONE), F.col("text")).otherwise(F.concat(F.col("text"), F.lit(" "), remark))
    alone = rows(documents.filter(slot.isin(ALONE)), -1 - F.col("doc_id"), "x", remark)
    return rows(documents, F.col("doc_id"), "c", with_remark).unionByName(alone)
