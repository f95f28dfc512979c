"""Texts against keyword and phrase tables of any size.

A table is written once and measured. If it is small it is one set that is sent to the executors;
flags and replaced texts are plain columns then. Otherwise texts are dealt into blocks of bounded
size, and each block gets the entries that may occur in it: every keyword has an anchor, a piece
that a text must have for the keyword to occur, and the table meets the different anchors of the
blocks in one join. So the work grows with the texts and with what they have in common with the
table, not with their product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkmill import schemas as S
from talkmill.functions import keywords as K
from talkmill.functions.binding import with_computed
from talkmill.functions.keywords import Keywords
from talkmill.functions.text import title_case, words
from talkmill.session import written

#: Bytes of keywords and values in one set; the automaton takes about ten times as much.
SET_BYTES = 16 << 20
#: Bytes of lower-cased text in one block (more where a single text is longer).
BLOCK_BYTES = 4 << 20
#: Anchors that a task remembers to send each once per block.
REMEMBERED = 1 << 19


def _entries(table: DataFrame, keyword: str, value: str | None) -> DataFrame:
    """(keyword in lower case, value), each keyword once, with its first value."""
    low = F.lower(F.col(keyword))
    rows = table.select(low.alias("keyword"), (low if value is None else F.coalesce(F.col(value), F.lit(""))).alias("value"))
    return rows.where("keyword <> ''").groupBy("keyword").agg(F.min("value").alias("value"))


def _measured(table: DataFrame, keyword: str, value: str | None) -> tuple[DataFrame, int]:
    """The entries, written once because tables may be costly to make, and their bytes."""
    entries = written(_entries(table, keyword, value), "keywords")
    return entries, entries.agg(F.sum(F.octet_length("keyword") + F.octet_length("value") + 16)).first()[0] or 0


def _collected(entries: DataFrame, whole_words: bool) -> Keywords:
    return Keywords(entries.sparkSession, {r["keyword"]: r["value"] for r in entries.collect()}, whole_words)


def keyword_sets(table: DataFrame, keyword: str = "keyword", value: str | None = None, whole_words: bool = False, set_bytes: int = SET_BYTES) -> Iterator[Keywords]:
    """The sets of a keyword table, at least one; a set is collected when it is asked for."""
    entries, size = _measured(table, keyword, value)
    sets = -(-size // set_bytes) or 1
    for i in range(sets):
        yield _collected(entries if sets == 1 else entries.where(F.pmod(F.xxhash64("keyword"), F.lit(sets)) == i), whole_words)


def _low(text: str) -> Column:
    return F.lower(F.col(text))


# --- tables larger than a set -------------------------------------------------------
def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their block; the last column is their size."""
    start, first = 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        sizes = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        ends = start + np.cumsum(sizes)
        start = int(ends[-1]) if len(ends) else start
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(first + (ends - sizes) // BLOCK_BYTES, pa.int64())], names=[*batch.schema.names[:-1], "_block"])


def _block_anchors(batches: Iterator[pa.RecordBatch], whole_words: bool, kinds: set[int]) -> Iterator[pa.RecordBatch]:
    """(block, anchor) of (block, text); an anchor may come back more than once."""
    block, parts, known = None, set(), set()
    for batch in batches:
        blocks, anchors = [], []
        for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text is None:
                continue
            if own != block or len(known) > REMEMBERED:
                block, parts, known = own, set(), set()
            if whole_words:
                found = K.word_anchors(text, kinds)
            else:
                found, fresh = {""} if 0 in kinds else set(), set(text.split()) - parts
                parts |= fresh
                for part in fresh:
                    found |= K.piece_anchors(part, kinds)
            found -= known
            known |= found
            blocks += [own] * len(found)
            anchors += found
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(anchors, pa.string())], names=["_block", "anchor"])


def _in_blocks(df: DataFrame, subject: Column, size: Column, anchors: Callable[[DataFrame], DataFrame], entries: DataFrame,
               of: Callable[[dict[str, str]], Callable], into: str, kind: str, keep: list[str] | None = None) -> DataFrame:
    """All columns, or those of ``keep``, and what ``of(entries of the block)`` makes of every subject; null gives null.

    ``anchors`` gives the (_block, anchor) of rows with (_block, _of), ``entries`` has (keyword, value, anchor).
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != into]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], subject.alias("_of"), (F.coalesce(size, F.lit(0)) + 64).cast("long").alias("_size"))
    fields = rows.drop("_size").schema
    dealt = written(rows.mapInArrow(_dealt, fields.add("_block", "long")), "texts")
    # Few rows a block: as many partitions as blocks, which AQE leaves apart.
    parts = max(1, min(dealt.select("_block").distinct().count(), 1 << 13))
    met = anchors(dealt.select("_block", "_of")).select(F.col("_block").alias("_to"), F.xxhash64("anchor").alias("_anchor"))
    own = met.join(entries.select(F.xxhash64("anchor").alias("_anchor"), "keyword", "value"), "_anchor").select("_to", "keyword", "value")
    column = pa.bool_() if kind == "boolean" else pa.int32() if kind == "int" else pa.string() if kind == "string" else pa.list_(pa.string())

    def solved(block: pa.Table, candidates: pa.Table) -> pa.Table:
        make = of(dict(zip(candidates["keyword"].to_pylist(), candidates["value"].to_pylist())))
        out = pa.array([None if t is None else make(t) for t in block["_of"].to_pylist()], column)
        return block.select(kept).append_column(into, out)

    schema = df.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast(kind).alias(into)).schema
    return dealt.repartition(parts, "_block").groupBy("_block").cogroup(own.repartition(parts, "_to").groupBy("_to")).applyInArrow(solved, schema)


def _matched(df: DataFrame, text: str, entries: DataFrame, whole_words: bool, of: Callable, into: str, kind: str,
             keep: list[str] | None = None) -> DataFrame:
    """All columns, or those of ``keep``, and ``of(text, finder)`` of every lower-cased text; null gives null."""
    anchor_of = K.word_anchor if whole_words else K.piece_anchor

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchor_of(k) for k in batch.column(0).to_pylist()]
            columns = [pa.array([kind for kind, _ in found], pa.int32()), pa.array([anchor for _, anchor in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["keyword", "value", "kind", "anchor"])

    anchored = written(entries.select("keyword", "value").mapInArrow(anchors, "keyword string, value string, kind int, anchor string"), "anchors")
    kinds = {r["kind"] for r in anchored.select("kind").distinct().collect()}

    def matcher(own: dict[str, str]) -> Callable:
        finder = K.Finder(own, whole_words)
        return lambda t: of(t, finder)

    return _in_blocks(df, _low(text), F.octet_length(F.col(text)), lambda rows: rows.mapInArrow(
        lambda batches: _block_anchors(batches, whole_words, kinds), "_block long, anchor string"), anchored, matcher, into, kind, keep)


# --- keywords -------------------------------------------------------------------------
def find_keywords(df: DataFrame, table: DataFrame, keep: list[str], text: str = S.CLEANED, keyword: str = "keyword",
                  whole_words: bool = False, set_bytes: int = SET_BYTES) -> DataFrame:
    """(keep..., keyword) for every keyword of the table that occurs in a text, ignoring case, once a text."""
    entries, size = _measured(table, keyword, None)
    if size <= set_bytes:
        return df.select(*keep, F.explode(_collected(entries, whole_words).found(_low(text))).alias("keyword"))
    # The kept columns may have the name of the text.
    slim = df.select(F.col(text).alias("_text"), *keep)
    found = _matched(slim, "_text", entries, whole_words, K.values_found, "_found", "array<string>", keep)
    return found.select(*keep, F.explode("_found").alias("keyword"))


def mark_keywords(df: DataFrame, table: DataFrame, into: str, text: str = S.CLEANED, key: str | None = None, keyword: str = "keyword",
                  whole_words: bool = False, set_bytes: int = SET_BYTES) -> DataFrame:
    """All columns and whether any keyword occurs; null text has none. ``key``, the column that names a row, must be given for tables larger than a set."""
    entries, size = _measured(table, keyword, None)
    if size <= set_bytes:
        return with_computed(df, {into: F.coalesce(_collected(entries, whole_words).occurs(_low(text)), F.lit(False))})
    _needed(key)
    return _matched(df, text, entries, whole_words, K.any_found, into, "boolean").withColumn(into, F.coalesce(into, F.lit(False)))


def _needed(key: str | None) -> None:
    if key is None:
        raise ValueError("a keyword table of several sets needs the name of a key column")


def competitors(df: DataFrame, table: DataFrame, keep: list[str], product: str = S.PRODUCT, text: str = S.CLEANED, set_bytes: int = SET_BYTES) -> DataFrame:
    """(keep..., product, competitor) for the keywords that belong to a text's product, or to no product.

    ``table`` has (product, keyword). Names are shown in title case where they begin with a letter.
    """
    found = find_keywords(df, table, [*keep, product], text, set_bytes=set_bytes)
    own = table.select(F.lower("keyword").alias("_keyword"), F.col("product").alias("_product")).distinct()
    joined = found.join(own, (F.col("keyword") == F.col("_keyword")) & (F.col("_product").isNull() | (F.col("_product") == F.col(product))))
    shown = F.when(F.substring("keyword", 1, 1).rlike(r"\p{L}"), title_case(F.col("keyword"))).otherwise(F.col("keyword"))
    return joined.select(*keep, product, shown.alias("competitor")).distinct()


def feature_rows(df: DataFrame, table: DataFrame, by: list[str] = (), text: str = S.CLEANED, set_bytes: int = SET_BYTES) -> DataFrame:
    """Per group and feature the summed rows of its keywords, as whole words; features without a row have none.

    ``table`` has (feature, keyword); what is found is counted by keyword before it meets the table.
    """
    found = find_keywords(df, table, list(by), text, whole_words=True, set_bytes=set_bytes).groupBy(*by, "keyword").agg(F.count("*").alias("n"))
    own = table.select("feature", F.lower("keyword").alias("_keyword")).distinct()
    return found.join(own, F.col("keyword") == F.col("_keyword")).groupBy(*by, "feature").agg(F.sum("n").alias("n"))


def feature_sentiments(df: DataFrame, table: DataFrame, positive: DataFrame, negative: DataFrame, key: str, text: str = S.CLEANED, set_bytes: int = SET_BYTES) -> DataFrame:
    """Per feature, mentioned or not: rows that mention a keyword of it and any positive / any negative word."""
    marked = mark_keywords(mark_keywords(df.select(key, text), positive, "_good", text, key, set_bytes=set_bytes), negative, "_bad", text, key, set_bytes=set_bytes)
    found = find_keywords(marked, table, [key, "_good", "_bad"], text, set_bytes=set_bytes)
    own = table.select("feature", F.lower("keyword").alias("_keyword")).distinct()
    rows = found.join(own, F.col("keyword") == F.col("_keyword")).select("feature", key, "_good", "_bad").distinct()
    counts = rows.groupBy("feature").agg(F.count_if("_good").alias("positive"), F.count_if("_bad").alias("negative"))
    return table.select(F.col("feature").alias("_feature")).distinct().join(counts, F.col("feature") == F.col("_feature"), "left").select(
        F.col("_feature").alias("feature"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("positive", "negative")])


# --- phrases --------------------------------------------------------------------------
def _dictionary(dictionary: dict[str, str] | DataFrame, spark: SparkSession, set_bytes: int) -> Keywords | DataFrame:
    """One set of a (source, english) table, or of a dict, which the driver holds already; the entries of a larger table."""
    if not isinstance(dictionary, DataFrame):
        return Keywords(spark, {k.lower(): v for k, v in dictionary.items()}, True)
    entries, size = _measured(dictionary, "source", "english")
    return _collected(entries, True) if size <= set_bytes else entries


def replace_phrases(df: DataFrame, dictionary: dict[str, str] | DataFrame, text: str, into: str, key: str | None = None, set_bytes: int = SET_BYTES) -> DataFrame:
    """All columns and the text in lower case with words and phrases of a dictionary replaced.

    Phrases end at word boundaries; where they overlap the leftmost is taken, of those the longest,
    and what replaces it is not looked up again. Blank texts stay as they are. ``key``, the column
    that names a row, must be given for dictionaries larger than a set.
    """
    own = _dictionary(dictionary, df.sparkSession, set_bytes)
    blank = F.size(words(F.col(text))) == 0
    if isinstance(own, Keywords):
        return with_computed(df, {into: F.when(blank, F.col(text)).otherwise(own.replaced(_low(text)))})
    _needed(key)
    made = _matched(df, text, own, True, K.all_replaced, "_new", "string")
    return made.withColumn(into, F.when(blank, F.col(text)).otherwise(F.col("_new"))).drop("_new")


def mark_dominated(df: DataFrame, dictionary: dict[str, str] | DataFrame, text: str, into: str, key: str | None = None,
                   share: float = 0.15, set_bytes: int = SET_BYTES) -> DataFrame:
    """All columns and whether at least ``share`` of the tokens between blanks are entries of the dictionary."""
    own = _dictionary(dictionary, df.sparkSession, set_bytes)
    tokens = words(_low(text))

    def enough(hits: Column) -> Column:
        return F.coalesce((F.size(tokens) > 0) & (hits / F.size(tokens) >= share), F.lit(False))

    if isinstance(own, Keywords):
        return with_computed(df, {into: enough(own.token_hits(tokens))})
    _needed(key)
    counted = _in_blocks(
        df, tokens, F.octet_length(F.col(text)), lambda rows: rows.select("_block", F.explode("_of").alias("anchor")).distinct(),
        own.withColumn("anchor", F.col("keyword")), lambda known: lambda ts: sum(t in known for t in ts), "_hits", "int")
    return counted.withColumn(into, enough(F.col("_hits"))).drop("_hits")
