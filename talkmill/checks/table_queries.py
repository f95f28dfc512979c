"""Sources, conformance, joins, aggregates, windows, samples and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill import schemas as S
from talkmill.checks import sql as Q
from talkmill.checks.bindings import lit
from talkmill.checks.registry import register
from talkmill.checks.text_queries import PSEUDO_SQL, pseudo
from talkmill.functions import flags as G, labels as B, lexicons as X, text as T
from talkmill.operators import annotation as A, cleaning as C, conform as P, dedup, insights as I, language_audit as L
from talkmill.operators import learning, master as M, metrics, profiling as PR, quality as QU, sampling as SA
from talkmill.sources import files, landed_json as J
from talkmill.session import run_dir


def raw():
    return F.col("comment_text")


_SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "boolean": "BOOLEAN"}


# --- sources and sinks --------------------------------------------------------
register("scan_parquet", lambda t: files.scan_parquet(t.spark, f"{t.dir}/lineitem.parquet").groupBy("l_returnflag").agg(
    F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders")),
    "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
register("scan_parquet_glob", lambda t: files.scan_parquet_glob(t.spark, t.dir, "{documents,benchmark,conversations}.parquet").agg(
    F.count("*").alias("rows"), F.count("doc_id").alias("documents"), F.count("item_id").alias("items"), F.count("conv_id").alias("turns"),
    F.sum(F.length("text")).alias("chars")),
    """SELECT count(*) AS rows, count(doc_id) AS documents, count(item_id) AS items, count(conv_id) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM
       (SELECT doc_id, NULL AS item_id, NULL AS conv_id, text FROM documents UNION ALL SELECT NULL, item_id, NULL, text FROM benchmark
        UNION ALL SELECT NULL, NULL, conv_id, text FROM conversations)""")
def _listed(t):
    """The listing against the scan: every file that rows come from is listed with its size."""
    at = f"{t.dir}/documents.parquet"
    listed = files.list_files(t.spark, at, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes")
    scanned = t.spark.read.parquet(at).groupBy(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
    return scanned.join(listed.withColumn("listed", F.lit(True)), ["name", "bytes"], "left").agg(F.sum("rows").alias("rows"), F.bool_and(F.coalesce("listed", F.lit(False))).alias("all_listed"))


register("list_files", _listed, "SELECT count(*) AS rows, true AS all_listed FROM documents")


def _latest(t):
    out = run_dir(t.spark, "latest")
    files.write_parquet(t.nation, f"{out}/a_first.parquet")
    files.write_parquet(t.region.repartition(4), f"{out}/b_second.parquet")
    return files.latest_dataset(t.spark, f"{out}/*", "*.parquet").select("r_regionkey", "r_name")


register("latest_dataset", _latest, "SELECT r_regionkey, r_name FROM region")


def _csv_round_trip(t):
    """All texts, with their line breaks and quotes, through files that many tasks cut and read."""
    out = run_dir(t.spark, "csv")
    files.write_csv(t.comments.select("comment_id", "comment_text", "like_count"), out)
    return files.scan_csv(t.spark, out).select("comment_id", raw().alias("comment_text"), F.col("like_count").cast("bigint").alias("like_count"))


register("scan_csv", _csv_round_trip, Q.with_comments(
    # Blank text is null after a CSV round trip.
    "SELECT comment_id, nullif(comment_text, '') AS comment_text, like_count FROM comments"))


def _csv_files(t):
    """Everything written, read back by the plain reader of whole files, and the first bytes of every file."""
    out = run_dir(t.spark, "bom")
    written = t.comments.select("comment_id", "comment_text", "product_query")
    files.write_csv(written, out)
    plain = t.spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True)
    back = plain.schema(written.schema).csv(out).select("comment_id", F.md5(F.coalesce("comment_text", F.lit(""))).alias("text"), "product_query")
    parts = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(out)
    marks = parts.select(F.lit("file").alias("comment_id"), F.hex(F.substring("content", 1, 3)).alias("text"), F.lit(None).cast("string").alias("product_query")).distinct()
    return back.union(marks)


register("write_csv", _csv_files, Q.with_comments("SELECT comment_id, md5(coalesce(comment_text, '')) AS text, product_query FROM comments UNION ALL SELECT 'file', 'EFBBBF', NULL"))


def _partitioned(t):
    out = run_dir(t.spark, "parquet")
    files.write_parquet(t.comments.withColumn("product_slug", T.product_slug(F.col("product_query"))), out, ["product_slug"])
    return t.spark.read.parquet(out).select("comment_id", "product_query", F.col("product_slug").cast("string").alias("product_slug"), F.md5("comment_text").alias("text"), "like_count")


register("write_parquet", _partitioned, Q.with_comments(f"SELECT comment_id, product_query, {Q.slug('product_query')} AS product_slug, md5(comment_text) AS text, like_count FROM comments"))


def _report(t):
    out = run_dir(t.spark, "report")
    files.write_report_json(C.preprocessing_report(C.flag_comments(t.comments)), out)
    return t.spark.read.json(out)


_REPORT = """count(*) AS original_rows, count(*) FILTER (NOT is_removed_by_cleaning) AS processed_rows,
  count(*) FILTER (is_spam) AS spam_count, count(*) FILTER (is_empty) AS empty_count, count(*) FILTER (is_deleted) AS deleted_count,
  count(*) FILTER (is_short_comment) AS short_comment_count, count(*) FILTER (is_single_word) AS single_word_count,
  count(*) FILTER (is_removed_by_cleaning) AS rows_removed_by_cleaning"""
register("write_report_json", _report, Q.with_flagged(f"SELECT {_REPORT} FROM flagged"))
register("table_shape", lambda t: files.table_shape(t.lineitem.drop("l_shipdate")),
         "SELECT ordinal_position - 1 AS position, column_name AS \"column\", CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' END AS type, (SELECT count(*) FROM lineitem) AS rows FROM information_schema.columns WHERE table_name = 'lineitem' AND column_name <> 'l_shipdate'")


def _slug():
    return T.product_slug(F.col("product_query"))


register("skip_processed",
         lambda t: files.skip_processed(t.comments.select(_slug().alias("product_slug"), "comment_id"),
                                        t.annotated.filter("like_count = 7").select(_slug().alias("product_slug"))),
         Q.with_annotated(f"SELECT s AS product_slug, comment_id FROM (SELECT {Q.slug('product_query')} AS s, comment_id FROM comments) WHERE s NOT IN (SELECT {Q.slug('product_query')} FROM annotated WHERE like_count = 7)"))

# --- landed API responses built from the given tables --------------------------


def _responses(t, kind: str):
    """One response per conversation: its turns are the items."""
    c, k = t.conversations, F.concat_ws("-", "conv_id", "turn")
    vid = F.when(F.col("turn") % 4 != 3, k)
    null = F.lit(None).cast("string")
    number = F.when(F.col("turn") % 3 == 0, F.lit("n/a")).otherwise(F.length("text").cast("string"))
    item = {
        "search": F.struct(F.struct(vid.alias("videoId")).alias("id"), F.struct(
            F.col("role").alias("title"), F.col("text").alias("description"), F.col("role").alias("channelTitle"),
            null.alias("channelId"), F.lit("2026-01-01T00:00:00Z").alias("publishedAt")).alias("snippet")),
        "videos": F.struct(vid.alias("id"), F.struct(F.col("text").alias("title"), F.col("role").alias("channelTitle"),
            F.when(F.col("role") == "user", F.array(F.col("role"))).alias("tags")).alias("snippet"),
            F.struct(number.alias("viewCount"), F.col("turn").cast("string").alias("likeCount")).alias("statistics"),
            F.struct(F.lit("PT5M").alias("duration")).alias("contentDetails")),
        "comments": F.struct(F.struct(F.col("conv_id").cast("string").alias("videoId"), F.struct(vid.alias("id"), F.struct(
            F.col("role").alias("authorDisplayName"), F.col("text").alias("textDisplay"), number.alias("likeCount"),
            ).alias("snippet")).alias("topLevelComment")).alias("snippet")),
    }[kind]
    grouped = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))).alias("t"))
    return grouped.select("conv_id", F.to_json(F.struct(F.transform("t", lambda x: x["item"]).alias("items"))).alias("body"))


_TURNS = "(SELECT *, conv_id || '-' || turn AS k FROM conversations WHERE turn % 4 <> 3)"
register("flatten_search_json", lambda t: J.flatten_search(_responses(t, "search"), " phone "),
         f"""SELECT 'phone' AS product_query, k AS video_id, '{X.WATCH_URL}' || k AS video_url, role AS title, text AS description,
             role AS channel_name, CAST(NULL AS VARCHAR) AS channel_id, '2026-01-01T00:00:00Z' AS published_at FROM {_TURNS}""")
register("flatten_video_json",
         lambda t: J.flatten_videos(_responses(t, "videos"), "phone", page="conv_id").withColumn("tags", F.array_join("tags", ",")),
         f"""SELECT k AS video_id, 'phone' AS product_query, text AS title, '{X.WATCH_URL}' || k AS video_url, role AS channel_name,
             CAST(NULL AS VARCHAR) AS published_at, CASE WHEN turn % 3 = 0 THEN NULL ELSE length(text) END AS view_count, turn AS like_count,
             CAST(NULL AS BIGINT) AS comment_count, 'PT5M' AS duration, CASE role WHEN 'user' THEN 'user' ELSE '' END AS tags,
             CAST(NULL AS VARCHAR) AS category_id FROM {_TURNS}""")
register("flatten_comment_json", lambda t: J.flatten_comments(_responses(t, "comments"), "phone", page="conv_id", per_video=3),
         f"""SELECT 'phone' AS product_query, conv_id::VARCHAR AS video_id, '{X.WATCH_URL}' || conv_id AS video_url, CAST(NULL AS VARCHAR) AS video_title,
             k AS comment_id, role AS author_name, text AS comment_text, CASE WHEN turn % 3 = 0 THEN NULL ELSE length(text) END AS like_count,
             CAST(NULL AS VARCHAR) AS published_at, CAST(NULL AS VARCHAR) AS updated_at
             FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM {_TURNS}) WHERE r <= 3""")
register("event_properties",
         lambda t: t.events.select("event_id", B.safe_long(F.get_json_object("props", "$.k")).alias("k")),
         "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
register("cap_per_video", lambda t: J.cap_per_video(t.conversations.select("conv_id", "turn", "role"), [F.col("turn")], 3, "conv_id"),
         "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 3")

# --- conformance ----------------------------------------------------------------
register("ensure_columns", lambda t: P.ensure_columns(t.comments),
         Q.with_comments("SELECT " + ", ".join(
             f.name if f.name in ("product_query", "video_id", "comment_id", "comment_text") else f"CAST(NULL AS {_SQL_TYPES[f.dataType.simpleString()]}) AS {f.name}"
             for f in S.MASTER) + " FROM comments"))
register("rename_comment_cols", lambda t: P.rename_comment_columns(t.comments.select("comment_id", "like_count", F.col("lang").alias("title"))),
         Q.with_comments("SELECT comment_id, like_count AS comment_like_count, lang AS video_title FROM comments"))
# Customers stand for videos (two rows each, the cheaper one first) and orders for comments.
_VIDEO_TABLE = """videos AS (SELECT c_custkey::VARCHAR AS video_id, c_mktsegment AS product_query, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS video_title,
  c_nationkey::BIGINT AS view_count, c_custkey % 10 AS video_like_count FROM customer)"""


def _videos(t):
    cheap = t.customer.select(
        F.col("c_custkey").cast("string").alias("video_id"), F.col("c_mktsegment").alias("product_query"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("title"), F.col("c_nationkey").cast("bigint").alias("view_count"),
        (F.col("c_custkey") % 10).alias("like_count"), F.lit(0).alias("version"))
    later = cheap.withColumns({"version": F.lit(1), "title": F.concat(F.lit("zz "), "title"), "product_query": F.lit("zz")})
    return cheap.unionByName(later)


def _orders_as_comments(t):
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("comment_id"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit("none")).otherwise(F.col("o_custkey").cast("string")).alias("video_id"),
        F.col("o_orderpriority").alias("product_query"), F.col("o_orderstatus").alias("title"), F.col("o_custkey").alias("like_count"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_at"))


_COMMENT_TABLE = """posts AS (SELECT o_orderkey::VARCHAR AS comment_id, CASE WHEN o_orderkey % 11 = 0 THEN 'none' ELSE o_custkey::VARCHAR END AS video_id,
  o_orderpriority AS product_query, o_orderstatus AS video_title, o_custkey AS comment_like_count, strftime(o_orderdate, '%Y-%m-%d') AS published_at FROM orders)"""
_NEEDED = ["product_query", "video_id", "video_title", "published_at", "view_count", "video_like_count", "comment_id", "comment_like_count"]
register("prepare_videos", lambda t: P.prepare_videos(_videos(t), ["version"]),
         f"WITH {_VIDEO_TABLE} SELECT video_id, product_query, video_title, view_count, video_like_count FROM videos")
_JOINED = """SELECT coalesce(v.product_query, p.product_query) AS product_query, p.video_id, coalesce(v.video_title, p.video_title) AS video_title,
  p.published_at, v.view_count, v.video_like_count, p.comment_id, p.comment_like_count FROM posts p LEFT JOIN videos v USING (video_id)"""
register("master_left_join", lambda t: M.build_master(_videos(t), _orders_as_comments(t), video_order=["version"]).select(*_NEEDED),
         f"WITH {_VIDEO_TABLE}, {_COMMENT_TABLE} {_JOINED}")
register("master_salted_join", lambda t: M.build_master(_videos(t), _orders_as_comments(t), salts=4, video_order=["version"]).select(*_NEEDED),
         f"WITH {_VIDEO_TABLE}, {_COMMENT_TABLE} {_JOINED}")


def _joined_pair(t):
    left = P.rename_comment_columns(_orders_as_comments(t))
    right = P.prepare_videos(_videos(t), ["version"])
    return M.coalesce_joined(M.left_join_unique(left, right, "video_id"), left.columns, right.columns, "video_id")


register("coalesce_join_cols", lambda t: _joined_pair(t).select("comment_id", "product_query", "video_title"),
         f"WITH {_VIDEO_TABLE}, {_COMMENT_TABLE} SELECT comment_id, product_query, video_title FROM ({_JOINED})")
_TEMPLATE = ["sentiment_label", "aspect_label", "review_notes", *[f"is_{n.lower().replace(' ', '_')}" for n in X.NOTE_LABELS]]
register("annotation_template", lambda t: P.annotation_template(t.comments),
         Q.with_comments("SELECT product_query, video_id, CAST(NULL AS VARCHAR) AS video_title, CAST(NULL AS VARCHAR) AS channel_name, comment_id, comment_text, CAST(NULL AS VARCHAR) AS cleaned_comment_text, CAST(NULL AS VARCHAR) AS comment_like_count, CAST(NULL AS VARCHAR) AS detected_language, "
                         + ", ".join(f"'' AS {c}" for c in _TEMPLATE) + " FROM comments"))
_NOTE = f"nullif({Q.title('trim(review_notes)')}, '')"
register("note_flags", lambda t: P.note_flags(t.annotated.select("comment_id", "review_notes")),
         Q.with_annotated(f"SELECT comment_id, {_NOTE} AS review_notes, " + ", ".join(
             f"CASE WHEN {_NOTE} = {lit(n)} THEN 1 ELSE 0 END AS is_{n.lower().replace(' ', '_')}" for n in X.NOTE_LABELS) + " FROM annotated"))
register("union_all_by_name", lambda t: P.union_by_name(t.documents.select("text", "doc_id", "lang"), t.benchmark.select("item_id", "text")),
         "SELECT text, doc_id, lang, NULL AS item_id FROM documents UNION ALL SELECT text, NULL, NULL, item_id FROM benchmark")
register("remainder_except", lambda t: SA.remainder_except(t.documents, SA.random_sample(t.documents.select("doc_id"), "doc_id", 100), "doc_id").select("doc_id", "source"),
         "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100)")

# --- joins ----------------------------------------------------------------------
register("unlabeled_anti_join", lambda t: learning.unlabeled(t.documents.select("doc_id", "source"), t.labels, "doc_id"),
         "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
register("remove_accepted", lambda t: pseudo(t).join(learning.high_confidence(pseudo(t)).select("event_id"), "event_id", "left_anti"),
         f"WITH {PSEUDO_SQL} SELECT * FROM pseudo WHERE confidence < 0.90::DOUBLE")
register("membership_filter", lambda t: t.annotated.filter(F.col("aspect_label").isin("Other", "Spam")).select("comment_id", "aspect_label"),
         Q.with_annotated("SELECT comment_id, aspect_label FROM annotated WHERE aspect_label IN ('Other', 'Spam')"))
register("keyword_contains_join", lambda t: I.keyword_join(t.comments, X.DEFAULT_COMPETITORS, "comment_id", "comment_text"),
         Q.with_comments(f"SELECT comment_id, keyword FROM comments JOIN (SELECT unnest([{Q.lits(X.DEFAULT_COMPETITORS)}]) AS keyword) ON contains(lower(comment_text), keyword)"))

# --- validation and profiles ------------------------------------------------------
register("duplicate_count", lambda t: QU.duplicate_count(t.documents, "text"),
         """SELECT 'text' AS "column", true AS column_present, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows,
            count(*) FILTER (n > 1) AS duplicate_values, CAST(sum(n) AS BIGINT) AS total_rows FROM (SELECT text, count(*) AS n FROM documents GROUP BY 1)""")
_ACOLS = ["comment_id", "comment_text", "sentiment_label", "aspect_label", "review_notes", "like_count"]


def _missing_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {lit(c)} AS \"column\", count(*) - count({c}) AS missing_count, (count(*) - count({c})) / count(*)::DOUBLE * 100 AS missing_percentage FROM {source}" for c in columns)


register("missing_by_column", lambda t: QU.missing_by_column(t.annotated.select(*_ACOLS), None), Q.with_annotated(_missing_sql("annotated", _ACOLS)))
register("missing_sorted", lambda t: QU.missing_sorted(t.annotated.select(*_ACOLS)),
         Q.with_annotated(f"SELECT \"column\", missing_count FROM ({_missing_sql('annotated', _ACOLS)}) WHERE missing_count > 0"))
register("missing_cell_pct", lambda t: QU.missing_cells(t.annotated.select(*_ACOLS), None),
         Q.with_annotated(f"SELECT m AS missing_cells, a AS all_cells, m / a::DOUBLE * 100 AS percentage_missing_values FROM (SELECT {' + '.join(f'(count(*) - count({c}))' for c in _ACOLS)} AS m, count(*) * {len(_ACOLS)} AS a FROM annotated)"))
register("pct_of_rows", lambda t: t.comments.groupBy("product_query").agg(F.count_if(raw().isNull()).alias("part"), F.count("*").alias("rows"))
         .withColumn("pct", B.percent(F.col("part"), F.col("rows"), None)),
         Q.with_comments("SELECT product_query, count(*) FILTER (comment_text IS NULL) AS part, count(*) AS rows, count(*) FILTER (comment_text IS NULL) / count(*)::DOUBLE * 100 AS pct FROM comments GROUP BY 1"))
_TQ = f"""count(*) FILTER (coalesce(comment_text, '') = '') AS empty_comments,
  count(*) FILTER (comment_text <> '' AND {Q.strip('comment_text')} = '') AS whitespace_only_comments,
  count(*) FILTER (length({Q.strip("coalesce(comment_text, '')")}) < 3) AS comments_shorter_than_3_characters"""
register("text_quality_counts", lambda t: QU.text_quality_counts(t.comments), Q.with_comments(f"SELECT {_TQ} FROM comments"))


def _video_quality(t):
    url = F.when(F.col("page_id") % 9 == 4, F.lit("not-a-url")).otherwise(F.col("url"))
    when = F.when(F.col("page_id") % 5 == 1, F.lit("bad-date")).when(F.col("page_id") % 5 == 2, F.lit("2026-01-01T00:00:00Z"))
    return t.pages.select((F.col("page_id") % 200).cast("string").alias("video_id"), url.alias("video_url"), when.alias("published_at"))


_VQ = """v AS (SELECT (page_id % 200)::VARCHAR AS video_id, CASE WHEN page_id % 9 = 4 THEN 'not-a-url' ELSE url END AS video_url,
  CASE WHEN page_id % 5 = 1 THEN 'bad-date' WHEN page_id % 5 = 2 THEN '2026-01-01T00:00:00Z' END AS published_at FROM pages)"""


def _long_sql(source: str, key: str, columns: list[str], metrics: list[tuple[str, str, str]]) -> str:
    rows = [("total_rows", "", "count(*)::DOUBLE")]
    rows += [("missing_count", c, f"(count(*) - count({c}))::DOUBLE") for c in columns]
    rows += [(m, k, f"({e})::DOUBLE") for m, k, e in metrics]
    missing = " + ".join(f"(count(*) - count({c}))" for c in columns)
    rows.append(("percentage_missing_values", "", f"round(({missing})::DOUBLE / (count(*) * {len(columns)})::DOUBLE * 100, 2)"))
    parts = [f"SELECT {lit(m)} AS metric, {lit(k)} AS key, {e} AS value FROM {source}" for m, k, e in rows]
    dup = f"(SELECT {key} AS k, count(*) AS n FROM {source} GROUP BY 1)"
    hit = "coalesce(sum(n) FILTER (n > 1 AND k IS NOT NULL), 0)::DOUBLE"
    parts += [
        f"SELECT 'duplicate_rows', {lit(key)}, {hit} FROM {dup}",
        f"SELECT 'duplicate_values', {lit(key)}, count(*) FILTER (n > 1 AND k IS NOT NULL)::DOUBLE FROM {dup}",
        f"SELECT 'percentage_duplicates', {lit(key)}, round({hit} / sum(n)::DOUBLE * 100, 2) FROM {dup}",
    ]
    return " UNION ALL ".join(parts)


_BAD = "count(*) FILTER ({0} IS NOT NULL AND try_cast({0} AS TIMESTAMPTZ) IS NULL)"
register("validate_videos", lambda t: QU.validate_videos(_video_quality(t)), f"WITH {_VQ} " + _long_sql(
    "v", "video_id", ["video_id", "video_url", "published_at"],
    [("invalid_urls", "", "count(*) FILTER (NOT regexp_matches(video_url, '(?i)^https?://'))"), ("invalid_timestamps", "published_at", _BAD.format("published_at"))]))


def _comment_quality(t):
    when = F.when(F.col("doc_id") % 5 == 1, F.lit("bad-date")).when(F.col("doc_id") % 5 == 2, F.lit("2026-01-01T00:00:00Z"))
    return t.comments.select(F.concat(F.lit("c"), (F.col("doc_id") % 900).cast("string")).alias("comment_id"), "video_id", "comment_text",
                             when.alias("published_at"), F.lit(None).cast("string").alias("updated_at"))


_CQ = """q AS (SELECT 'c' || (doc_id % 900) AS comment_id, video_id, comment_text, CASE WHEN doc_id % 5 = 1 THEN 'bad-date' WHEN doc_id % 5 = 2 THEN '2026-01-01T00:00:00Z' END AS published_at,
  CAST(NULL AS VARCHAR) AS updated_at FROM comments)"""
_SHORT = f"count(*) FILTER (length({Q.strip(chr(99) + 'oalesce(comment_text, ' + lit('') + ')')}) < 3)"
register("validate_comments", lambda t: QU.validate_comments(_comment_quality(t)), Q.with_comments(_long_sql(
    "q", "comment_id", ["comment_id", "video_id", "comment_text", "published_at", "updated_at"],
    [("empty_comments", "", "count(*) FILTER (coalesce(comment_text, '') = '')"),
     ("whitespace_only_comments", "", f"count(*) FILTER (comment_text <> '' AND {Q.strip('comment_text')} = '')"),
     ("comments_shorter_than_3_characters", "", _SHORT), ("invalid_timestamps", "published_at", _BAD.format("published_at")), ("invalid_timestamps", "updated_at", _BAD.format("updated_at")),
     ("percentage_empty_comments", "", "round(count(*) FILTER (coalesce(comment_text, '') = '') / count(*)::DOUBLE * 100, 2)"),
     ("percentage_very_short_comments", "", f"round({_SHORT} / count(*)::DOUBLE * 100, 2)")]), _CQ))
register("profile_videos",
         lambda t: PR.profile_videos(t.orders.select(F.col("o_custkey").cast("string").alias("channel_name"), F.col("o_custkey").cast("string").alias("view_count"),
                                                     F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey").cast("string")).otherwise(F.col("o_orderpriority")).alias("like_count"), F.lit(1).alias("comment_count"))),
         """SELECT count(*) AS number_of_videos, count(DISTINCT o_custkey) AS unique_channels, round(avg(o_custkey), 2) AS average_views,
            round(avg(o_orderkey) FILTER (o_orderkey % 3 <> 0), 2) AS average_likes, 1.0::DOUBLE AS average_comments FROM orders""")
register("profile_comments", lambda t: PR.profile_comments(t.comments, digits=None),
         Q.with_comments("""SELECT count(*) AS total_comments, CAST(sum(length(coalesce(comment_text, ''))) AS DOUBLE) / count(*)::DOUBLE AS average_comment_length,
            quantile_cont(length(coalesce(comment_text, '')), 0.5) AS median_comment_length, count(DISTINCT video_id) AS unique_videos_represented FROM comments"""))
register("comments_per_video", lambda t: PR.comments_per_video(t.conversations, "conv_id"), "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
register("comments_per_video_summary", lambda t: PR.comments_per_video_summary(t.conversations, "conv_id", None),
         """SELECT count(*) AS videos_with_comments, min(n) AS min_comments_per_video, max(n) AS max_comments_per_video,
            sum(n)::DOUBLE / count(*)::DOUBLE AS average_comments_per_video, quantile_cont(n, 0.5) AS median_comments_per_video FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)""")
register("language_distribution", lambda t: L.language_distribution(L.add_detected_language(t.comments), digits=None),
         Q.with_comments(f"SELECT label AS detected_language, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE * 100 AS pct FROM (SELECT {Q.detect_language('comment_text')} AS label FROM comments) GROUP BY 1"))
register("preprocessing_report", lambda t: C.preprocessing_report(C.flag_comments(t.comments)), Q.with_flagged(f"SELECT {_REPORT} FROM flagged"))
register("aggregate_reports", lambda t: C.preprocessing_report(C.flag_comments(t.comments), "product_query"),
         Q.with_flagged(f"SELECT product_query, 'product' AS scope, {_REPORT} FROM flagged GROUP BY 1 UNION ALL SELECT NULL, 'total', {_REPORT} FROM flagged"))
_DUPLICATED = "(SELECT *, doc_id % 800 AS k FROM documents)"
register("master_report", lambda t: (lambda d: M.master_report(dedup.keep_first(d, "comment_id", [F.col("doc_id")]), d, 2, 1, d))(
    t.documents.select("doc_id", (F.col("doc_id") % 800).alias("comment_id"), F.col("source").alias("product_query"), (F.col("doc_id") % 97).alias("video_id"))),
    f"""SELECT (SELECT count(DISTINCT source) FROM documents WHERE doc_id < 800) AS product_count, 2 AS video_files_found, 1 AS comment_files_found, count(DISTINCT k) AS total_comments,
        count(DISTINCT doc_id % 97) AS total_videos, count(*) - count(DISTINCT k) AS duplicate_comments_removed FROM {_DUPLICATED}""")
register("products", lambda t: M.products(t.comments), Q.with_comments("SELECT DISTINCT product_query FROM comments"))
register("annotation_report", lambda t: A.annotation_report(t.annotated), Q.with_annotated(
    """SELECT count(*) AS total_rows, count(*) FILTER (trim(coalesce(sentiment_label, '')) <> '' AND trim(coalesce(aspect_label, '')) <> '') AS labeled_rows,
       count(*) FILTER (trim(coalesce(sentiment_label, '')) = '') AS missing_sentiment_labels, count(*) FILTER (trim(coalesce(aspect_label, '')) = '') AS missing_aspect_labels FROM annotated"""))
register("annotation_label_counts", lambda t: A.label_counts(t.annotated, "sentiment_label"),
         Q.with_annotated("SELECT trim(sentiment_label) AS label, count(*) AS n FROM annotated WHERE trim(sentiment_label) <> '' GROUP BY 1"))
register("annotation_overview", lambda t: A.annotation_overview(t.annotated, ["sentiment_label", "aspect_label", "review_notes"]), Q.with_annotated(
    "SELECT count(*) AS total_rows, count(DISTINCT product_query) AS products, count(sentiment_label) AS sentiment_label_filled, count(aspect_label) AS aspect_label_filled, count(review_notes) AS review_notes_filled FROM annotated"))
register("crosstab", lambda t: A.crosstab(t.annotated, "product_query", "aspect_label", X.ASPECT_LABELS), Q.with_annotated(
    "SELECT product_query, " + ", ".join(f"count(*) FILTER (aspect_label = {lit(a)}) AS {a.lower().replace(' ', '_')}" for a in X.ASPECT_LABELS) + " FROM annotated WHERE aspect_label IS NOT NULL GROUP BY 1"))
register("crosstab_roles", lambda t: A.crosstab(t.conversations, "conv_id", "role", ["user", "assistant", "system"]),
         "SELECT conv_id, " + ", ".join(f"count(*) FILTER (role = {lit(r)}) AS \"{r}\"" for r in ("user", "assistant", "system")) + " FROM conversations GROUP BY 1")
register("aspect_quality", lambda t: A.aspect_quality(t.annotated, None), Q.with_annotated(
    """SELECT *, has_notes / n::DOUBLE * 100 AS notes_ratio, is_translated / n::DOUBLE * 100 AS translated_ratio FROM
       (SELECT aspect_label, count(*) AS n, count(review_notes) AS has_notes, count(*) FILTER (is_translated) AS is_translated FROM annotated WHERE aspect_label IS NOT NULL GROUP BY 1)"""))
register("class_buckets", lambda t: A.class_buckets(t.annotated, "aspect_label"), Q.with_annotated(
    """SELECT aspect_label, n, CASE WHEN n <= 10 THEN 'rare' WHEN n <= 20 THEN 'low' ELSE 'adequate' END AS bucket, max(n) OVER () / n::DOUBLE AS imbalance,
       n / (sum(n) OVER ())::DOUBLE * 100 AS pct FROM (SELECT aspect_label, count(*) AS n FROM annotated WHERE aspect_label IS NOT NULL GROUP BY 1)"""))
_NOTED = f"noted AS (SELECT * REPLACE ({_NOTE} AS review_notes) FROM annotated)"
register("consistency_checks", lambda t: A.consistency_checks(P.note_flags(t.annotated)), Q.with_annotated(
    """SELECT *, CASE WHEN question_rows = 0 THEN 0 ELSE question_neutral / question_rows::DOUBLE * 100 END AS question_neutral_pct,
       CASE WHEN unrelated_rows = 0 THEN 0 ELSE unrelated_other_spam / unrelated_rows::DOUBLE * 100 END AS unrelated_other_spam_pct FROM
       (SELECT count(*) FILTER (review_notes = 'Question') AS question_rows, count(*) FILTER (review_notes = 'Question' AND sentiment_label = 'Neutral') AS question_neutral,
        count(*) FILTER (review_notes = 'Unrelated') AS unrelated_rows, count(*) FILTER (review_notes = 'Unrelated' AND aspect_label IN ('Other', 'Spam')) AS unrelated_other_spam FROM noted)""", _NOTED))
register("note_distribution", lambda t: A.note_distribution(P.note_flags(t.annotated), "sentiment_label"), Q.with_annotated(
    "SELECT review_notes, sentiment_label, count(*) AS n FROM noted WHERE review_notes IS NOT NULL AND sentiment_label IS NOT NULL GROUP BY 1, 2", _NOTED))
_FLAGGED_ANNOTATIONS = f"fa AS (SELECT *, {Q.is_spam('comment_text')} AS is_spam, {Q.is_short('comment_text')} AS is_short_comment, {Q.is_single_word('comment_text')} AS is_single_word, coalesce(aspect_label = 'Spam', false) AS ls FROM annotated)"
register("flag_mismatch", lambda t: A.flag_mismatch(t.flagged_annotations), Q.with_annotated(
    """SELECT count(*) FILTER (ls) AS labeled_spam, count(*) FILTER (is_spam) AS flagged_spam, count(*) FILTER (ls AND is_spam) AS both, count(*) FILTER (ls AND NOT is_spam) AS label_only,
       count(*) FILTER (NOT ls AND is_spam) AS flag_only, count(*) FILTER (ls AND is_short_comment) AS short_and_labeled, count(*) FILTER (ls AND is_single_word) AS single_word_and_labeled FROM fa""", _FLAGGED_ANNOTATIONS))
register("spam_sets", lambda t: A.spam_sets(t.flagged_annotations).select("comment_id", "agreement"), Q.with_annotated(
    "SELECT comment_id, CASE WHEN ls AND is_spam THEN 'hit' WHEN ls THEN 'miss' ELSE 'false_positive' END AS agreement FROM fa WHERE ls OR is_spam", _FLAGGED_ANNOTATIONS))
register("product_stats", lambda t: A.product_stats(t.flagged_annotations), Q.with_annotated(
    "SELECT product_query, count(comment_id) AS comments, count(*) FILTER (is_spam) AS spam, count(*) FILTER (is_translated) AS translated, count(*) FILTER (is_short_comment) AS short FROM fa GROUP BY 1", _FLAGGED_ANNOTATIONS))
register("dataset_kpis", lambda t: A.dataset_kpis(t.comments.withColumns({"is_spam": G.is_spam(raw()), "is_translated": F.col("lang") != "en"}), t.labels), Q.with_comments(
    f"SELECT count(*) AS total_comments, count(DISTINCT product_query) AS products, count(*) FILTER ({Q.is_spam('comment_text')}) AS spam_flagged, count(*) FILTER (lang <> 'en') AS translated, (SELECT count(*) FROM labels) AS annotated FROM comments"))
_DESCRIBE = """SELECT CAST(n AS BIGINT) AS count, s / n AS mean, sqrt((q - s * s / n) / (n - 1)) AS std, lo AS min, q25, q50, q75, hi AS max FROM (
  SELECT count(v)::DOUBLE AS n, sum(v)::DOUBLE AS s, sum(v * v)::DOUBLE AS q, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75 FROM ({0}))"""
register("describe_numeric", lambda t: PR.describe(t.documents, F.length("text")), _DESCRIBE.format("SELECT length(text)::BIGINT AS v FROM documents"))
register("describe_likes", lambda t: PR.describe(t.comments, F.col("like_count")), Q.with_comments(_DESCRIBE.format("SELECT like_count AS v FROM comments")))
# No two values are equal: nothing is gained by counting them.
register("describe_distinct", lambda t: PR.describe(t.lineitem, F.col("l_orderkey") * 10 + F.col("l_linenumber")), _DESCRIBE.format("SELECT l_orderkey::BIGINT * 10 + l_linenumber AS v FROM lineitem"))
register("weight_stats_distinct", lambda t: SA.weight_stats(t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("double").alias("w")), "w"),
         "SELECT min(w) AS min_weight, max(w) AS max_weight, list(w ORDER BY w)[count(*) // 2 + 1] AS upper_median FROM (SELECT (l_orderkey::BIGINT * 10 + l_linenumber)::DOUBLE AS w FROM lineitem)")
register("histogram", lambda t: PR.histogram(t.documents, F.length("text")),
         """SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) * 50 / (hi - lo)), 49) END AS INT) AS bin, count(*) AS n
            FROM (SELECT length(text)::DOUBLE AS v, min(length(text)) OVER ()::DOUBLE AS lo, max(length(text)) OVER ()::DOUBLE AS hi FROM documents) GROUP BY 1""")
register("value_counts", lambda t: PR.value_counts(t.comments, "like_count", 20),
         Q.with_comments("SELECT like_count, count(*) AS n FROM comments GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"))
register("spam_pct", lambda t: PR.spam_share(t.comments.select(G.is_spam(raw()).alias("is_spam"))),
         Q.with_comments(f"SELECT count(*) FILTER ({Q.is_spam('comment_text')}) / count(*)::DOUBLE * 100 AS spam_pct FROM comments"))
register("text_length_summary", lambda t: PR.text_length_summary(t.documents, "text"),
         "SELECT count(text) AS count, sum(length(text))::DOUBLE / count(text)::DOUBLE AS mean_length, quantile_cont(length(text), 0.5) AS median_length FROM documents")
register("raw_vs_clean_length", lambda t: PR.raw_vs_clean_length(C.flag_comments(t.comments)), Q.with_flagged(
    "SELECT sum(length(comment_text))::DOUBLE / count(comment_text)::DOUBLE AS raw_mean_length, sum(length(cleaned_comment_text))::DOUBLE / count(*)::DOUBLE AS clean_mean_length FROM flagged"))
register("max_likes", lambda t: t.comments.groupBy("product_query").agg(F.max("like_count").alias("max_likes")),
         Q.with_comments("SELECT product_query, max(like_count) AS max_likes FROM comments GROUP BY 1"))
register("weight_stats", lambda t: SA.weight_stats(t.comments.select(F.round(B.like_weight(F.col("like_count")), 9).alias("w")), "w"),
         Q.with_comments("SELECT min(w) AS min_weight, max(w) AS max_weight, list(w ORDER BY w)[count(*) // 2 + 1] AS upper_median FROM (SELECT round(least(1 + log2(1 + like_count), 10), 9) AS w FROM comments)"))
register("class_weight", lambda t: SA.class_weights(t.embeddings, "label").withColumn("weight", F.round("weight", 9)),
         "SELECT label, n, round((1.0::DOUBLE / n) / (sum(1.0::DOUBLE / n) OVER ()) * count(*) OVER (), 9) AS weight FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
register("class_distribution", lambda t: A.class_distribution(t.annotated, "aspect_label"), Q.with_annotated(" UNION ALL ".join(
    f"SELECT {lit(a)} AS label, count(*) FILTER (aspect_label = {lit(a)}) AS n, count(*) FILTER (aspect_label = {lit(a)}) / count(*)::DOUBLE * 100 AS pct FROM annotated" for a in X.ASPECT_LABELS)))
register("pseudolabel_distribution", lambda t: pseudo(t).groupBy("pseudo_aspect").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.9).alias("n_high")),
         f"WITH {PSEUDO_SQL} SELECT pseudo_aspect, count(*) AS n, count(*) FILTER (confidence >= 0.9::DOUBLE) AS n_high FROM pseudo GROUP BY 1")
register("other_proportion", lambda t: metrics.label_share(pseudo(t), "pseudo_aspect"),
         f"WITH {PSEUDO_SQL} SELECT count(*) FILTER (pseudo_aspect = 'Other') / count(*)::DOUBLE * 100 AS pct FROM pseudo")

# --- evaluation -------------------------------------------------------------------
# Truth: the type of an event; prediction: the type chosen by its value and user.
_KINDS = ["click", "error", "purchase", "signup", "view"]


def _pred():
    return F.when(F.col("user_id") % 3 == 0, F.col("event_type")).when(F.col("value") > 60, F.lit("view")).when(
    F.col("value") > 20, F.lit("click")).otherwise(F.lit("outside"))


PREDICTED_SQL = """pr AS (SELECT event_id, user_id, event_type AS truth, CASE WHEN user_id % 3 = 0 THEN event_type WHEN value > 60 THEN 'view' WHEN value > 20 THEN 'click' ELSE 'outside' END AS pred FROM events)"""
_LABELS = [*_KINDS, "never"]


def _predicted(t):
    return t.events.select("event_id", "user_id", F.col("event_type").alias("truth"), _pred().alias("pred"))


_LABEL_LIST = ", ".join(lit(k) for k in _LABELS)
_GRID = f"grid AS (SELECT t.l AS truth, p.l AS pred FROM (SELECT unnest([{_LABEL_LIST}]) AS l) t, (SELECT unnest([{_LABEL_LIST}]) AS l) p)"
_CM = f"{PREDICTED_SQL}, {_GRID}, cm AS (SELECT g.truth, g.pred, count(pr.truth) AS n FROM grid g LEFT JOIN pr ON pr.truth = g.truth AND pr.pred = g.pred GROUP BY 1, 2)"


def _per_label(source: str, by: str = "") -> str:
    k = f"{by}, " if by else ""
    on = f"WHERE s.{by} = g.{by} AND" if by else "WHERE"
    head = f"g.{by}, " if by else ""
    g = f"(SELECT DISTINCT {by} FROM {source}) g, " if by else ""
    counts = f"""SELECT {head}l.label,
      (SELECT count(*) FROM {source} s {on} s.truth = l.label AND s.pred = l.label) AS tp,
      (SELECT count(*) FROM {source} s {on} s.pred = l.label) AS predicted, (SELECT count(*) FROM {source} s {on} s.truth = l.label) AS support
      FROM {g}(SELECT unnest([{_LABEL_LIST}]) AS label) l"""
    ratio = "CASE WHEN {1} = 0 THEN 0.0::DOUBLE ELSE {0}::DOUBLE / {1}::DOUBLE END"
    return f"""(SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM
      (SELECT {k}label, tp, predicted, support, {ratio.format('tp', 'predicted')} AS precision, {ratio.format('tp', 'support')} AS recall FROM ({counts})))"""


def _macro(measure: str) -> str:
    return "(" + " + ".join(f"max({measure}) FILTER (label = {lit(k)})" for k in _LABELS) + f") / {len(_LABELS)}"


register("confusion_matrix", lambda t: metrics.confusion_matrix(_predicted(t), "truth", "pred", _LABELS), f"WITH {_CM} SELECT * FROM cm")
register("classification_metrics", lambda t: metrics.per_label_metrics(_predicted(t), "truth", "pred", _LABELS),
         f"WITH {PREDICTED_SQL} SELECT * FROM {_per_label('pr')}")
register("overall_metrics", lambda t: metrics.overall_metrics(_predicted(t), "truth", "pred", _LABELS),
         f"WITH {PREDICTED_SQL} SELECT (SELECT count(*) FILTER (truth = pred)::DOUBLE / count(*)::DOUBLE FROM pr) AS accuracy, {_macro('precision')} AS macro_precision, {_macro('recall')} AS macro_recall, {_macro('f1')} AS macro_f1 FROM {_per_label('pr')}")
register("per_class_accuracy", lambda t: metrics.per_class_accuracy(metrics.confusion_matrix(_predicted(t), "truth", "pred", _LABELS)),
         f"""WITH {_CM}, tot AS (SELECT sum(n) AS total FROM cm) SELECT l.label, ((SELECT total FROM tot) - t.n - p.n + 2 * d.n)::DOUBLE / (SELECT total FROM tot)::DOUBLE AS accuracy
             FROM (SELECT unnest([{_LABEL_LIST}]) AS label) l JOIN (SELECT truth, sum(n) AS n FROM cm GROUP BY 1) t ON t.truth = l.label
             JOIN (SELECT pred, sum(n) AS n FROM cm GROUP BY 1) p ON p.pred = l.label JOIN cm d ON d.truth = l.label AND d.pred = l.label""")
register("top_confusions", lambda t: metrics.top_confusions(metrics.confusion_matrix(_predicted(t), "truth", "pred", _LABELS)),
         f"WITH {_CM} SELECT truth, pred, n FROM cm WHERE truth <> pred AND n > 0 ORDER BY n DESC, truth, pred LIMIT 5")
register("low_recall_classes", lambda t: metrics.low_recall(metrics.per_label_metrics(_predicted(t), "truth", "pred", _LABELS)).select("label", "recall"),
         f"WITH {PREDICTED_SQL} SELECT label, recall FROM {_per_label('pr')} WHERE recall < 0.5::DOUBLE")
_SCORERS = {
    "by_value": lambda d: d.withColumn("predicted", F.col("pred")),
    "always_view": lambda d: d.withColumn("predicted", F.lit("view")),
}
_SCORED_LONG = f"{PREDICTED_SQL}, sc AS (SELECT 'by_value' AS scorer, truth, pred FROM pr UNION ALL SELECT 'always_view', truth, 'view' FROM pr)"
_COMPARED = f"""(SELECT m.scorer, a.accuracy, {_macro('precision')} AS macro_precision, {_macro('recall')} AS macro_recall, {_macro('f1')} AS macro_f1 FROM {_per_label('sc', 'scorer')} m
  JOIN (SELECT scorer, count(*) FILTER (truth = pred)::DOUBLE / count(*)::DOUBLE AS accuracy FROM sc GROUP BY 1) a USING (scorer) GROUP BY 1, 2)"""
register("score_comparison", lambda t: metrics.score_comparison(_predicted(t), _SCORERS, "truth", _LABELS), f"WITH {_SCORED_LONG} SELECT * FROM {_COMPARED}")
register("best_scorer", lambda t: metrics.best_scorer(metrics.score_comparison(_predicted(t), _SCORERS, "truth", _LABELS)),
         f"WITH {_SCORED_LONG} SELECT scorer, accuracy FROM {_COMPARED} ORDER BY accuracy DESC, scorer LIMIT 1")
register("metric_compare_join",
         lambda t: metrics.compare_metrics(
             metrics.per_label_metrics(_predicted(t).withColumn("pred", F.lit("view")), "truth", "pred", _LABELS),
             metrics.per_label_metrics(_predicted(t), "truth", "pred", _LABELS), ["label"], "f1"),
         f"""WITH {_SCORED_LONG} SELECT label, b.f1 AS baseline, c.f1 AS candidate, c.f1 - b.f1 AS delta FROM (SELECT * FROM {_per_label('sc', 'scorer')} WHERE scorer = 'always_view') b
             FULL JOIN (SELECT * FROM {_per_label('sc', 'scorer')} WHERE scorer = 'by_value') c USING (label)""")
register("cv_summary",
         lambda t: metrics.cv_summary(metrics.fold_accuracy(SA.stratified_kfold(_predicted(t), "truth", "event_id"), "fold", "truth", "pred"))
         .select(F.round("mean_accuracy", 9).alias("mean_accuracy"), F.round("std_accuracy", 9).alias("std_accuracy")),
         f"""WITH {PREDICTED_SQL}, f AS (SELECT *, (row_number() OVER (PARTITION BY truth ORDER BY md5('42:' || event_id), event_id) - 1) % 5 AS fold FROM pr),
             a AS (SELECT fold, count(*) FILTER (truth = pred)::DOUBLE / count(*)::DOUBLE AS acc FROM f GROUP BY 1) SELECT round(avg(acc), 9) AS mean_accuracy, round(stddev_pop(acc), 9) AS std_accuracy FROM a""")

# --- windows, top-k, samples --------------------------------------------------------
register("keep_first_dedup", lambda t: dedup.keep_first(
    t.documents.select("doc_id", F.when(F.col("doc_id") % 50 != 7, F.sha2("text", 256)).alias("k"), "text"), "k", [F.col("doc_id")]).select("doc_id", "text"),
    """SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN doc_id % 50 <> 7 THEN text END ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
register("dedup_removed", lambda t: dedup.removed_count(t.documents, "text"), "SELECT count(*) - count(DISTINCT text) AS removed FROM documents")
register("top_examples_per_language", lambda t: L.top_examples(L.add_detected_language(t.comments), "comment_id"), Q.with_comments(
    f"""SELECT detected_language, example_rank, example FROM (SELECT *, row_number() OVER (PARTITION BY detected_language ORDER BY comment_id) AS example_rank FROM
        (SELECT comment_id, {Q.detect_language('comment_text')} AS detected_language, {Q.strip('comment_text')} AS example FROM comments) WHERE example <> '') WHERE example_rank <= 5"""))
_SIZE, _SEED = 100, 7
register("balanced_quota_sample", lambda t: SA.quota_choice(t.comments.withColumn("product_query", F.when(F.col("doc_id") % 31 != 5, F.col("product_query"))), "comment_id", _SIZE, _SEED),
         Q.with_comments(f"""SELECT comment_id, row_number() OVER (ORDER BY md5('{_SEED}:shuffle:' || comment_id), comment_id) AS sample_order FROM (
           SELECT comment_id FROM ranked WHERE r <= quota UNION ALL
           SELECT comment_id FROM (SELECT comment_id, missing, row_number() OVER (ORDER BY h, comment_id) AS i FROM ranked, (SELECT max(target) - sum(quota) AS missing FROM quotas) WHERE r > quota) WHERE i <= missing)""",
           "c AS (SELECT comment_id, CASE WHEN doc_id % 31 <> 5 THEN product_query END AS p, md5('" + str(_SEED) + ":' || comment_id) AS h FROM comments)",
           f"sizes AS (SELECT p, count(*) AS size, least({_SIZE}, sum(count(*)) OVER ()) AS target, count(p) OVER () AS products, row_number() OVER (ORDER BY p NULLS LAST) AS place FROM c GROUP BY p)",
           "quotas AS (SELECT p, target, CASE WHEN p IS NULL THEN 0 ELSE least(target // products + CASE WHEN place <= target % products THEN 1 ELSE 0 END, size) END AS quota FROM sizes)",
           "ranked AS (SELECT c.*, quota, row_number() OVER (PARTITION BY c.p ORDER BY h, comment_id) AS r FROM c JOIN quotas q ON c.p IS NOT DISTINCT FROM q.p)"))
register("per_class_cap", lambda t: SA.per_class_cap(pseudo(t), "pseudo_aspect", "event_id", 150),
         f"WITH {PSEUDO_SQL} SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY pseudo_aspect ORDER BY event_id) AS r FROM pseudo) WHERE r <= 150")
register("top_longest_comments", lambda t: PR.top_longest(t.comments), Q.with_comments(
    "SELECT comment_id, video_id, comment_text, length(coalesce(comment_text, '')) AS comment_length FROM comments ORDER BY 4 DESC, 1 LIMIT 20"))
register("top_liked_comments", lambda t: PR.top_by(t.comments, "like_count", "comment_id", ["product_query", "comment_id", "like_count", "comment_text"]), Q.with_comments(
    "SELECT product_query, comment_id, like_count, comment_text FROM comments ORDER BY like_count DESC, comment_id LIMIT 20"))
register("top_channels", lambda t: PR.top_groups(t.comments, "video_id"), Q.with_comments("SELECT video_id, count(*) AS n FROM comments GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"))
register("random_sample_n", lambda t: SA.random_sample(t.documents.select("doc_id", "source"), "doc_id", 300),
         "SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 300")
register("browse_sample", lambda t: SA.browse_sample(
    t.comments.select("comment_id", F.col("like_count").alias("comment_like_count"), raw().alias(S.CLEANED)), "comment_id", 25, seed=3).select("comment_id", "comment_like_count", "shown"),
    Q.with_comments("SELECT comment_id, like_count AS comment_like_count, left(comment_text, 200) AS shown FROM comments WHERE like_count >= 25 AND comment_text IS NOT NULL ORDER BY md5('3:' || comment_id) LIMIT 10"))
register("shuffle", lambda t: SA.shuffle(t.documents.select("doc_id"), "doc_id"), "SELECT doc_id FROM documents")
register("hash_rank", lambda t: SA.rank_by_hash(t.events.select("event_id", "event_type"), ["event_type"], "event_id", 42),
         "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id), event_id) AS hash_rank, count(*) OVER (PARTITION BY event_type) AS group_total FROM events")
register("stratified_split", lambda t: SA.stratified_split(t.events.select("event_id", "event_type"), "event_type", "event_id"),
         """WITH s AS (SELECT event_type, count(*) AS size, sum(count(*)) OVER () AS total FROM events GROUP BY 1), w AS (SELECT *, ceil(total * 0.15::DOUBLE) AS wanted FROM s),
            f AS (SELECT *, floor(size * wanted / total::DOUBLE) AS whole, size * wanted / total::DOUBLE - floor(size * wanted / total::DOUBLE) AS part FROM w),
            a AS (SELECT event_type, whole + CASE WHEN row_number() OVER (ORDER BY part DESC, event_type) <= wanted - sum(whole) OVER () THEN 1 ELSE 0 END AS take FROM f)
            SELECT e.event_id, e.event_type, row_number() OVER (PARTITION BY e.event_type ORDER BY md5('42:' || e.event_id), e.event_id) <= a.take AS is_test FROM events e JOIN a USING (event_type)""")
register("stratified_kfold", lambda t: SA.stratified_kfold(t.embeddings.select("vec_id", "label"), "label", "vec_id"),
         "SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) - 1) % 5 AS INT) AS fold FROM embeddings")
_OVER = """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents),
  m AS (SELECT *, (SELECT max(n) FROM r) - n AS missing FROM r), c AS (SELECT *, missing // n + CASE WHEN k <= missing % n THEN 1 ELSE 0 END AS copies FROM m)
  SELECT doc_id, lang, false AS is_oversampled FROM c UNION ALL SELECT doc_id, lang, true FROM (SELECT doc_id, lang, unnest(range(copies)) FROM c)"""
register("random_oversample", lambda t: SA.random_oversample(t.documents.select("doc_id", "lang"), "lang", "doc_id"), _OVER)
register("class_distribution_change", lambda t: SA.distribution_change(
    t.documents, SA.random_oversample(t.documents.select("doc_id", "lang"), "lang", "doc_id"), "lang"),
    "SELECT lang, count(*) AS n_before, (SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) AS n_after, (SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) / count(*)::DOUBLE AS ratio FROM documents GROUP BY 1")
