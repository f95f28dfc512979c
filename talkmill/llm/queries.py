"""Registered queries of the training-data operators: name -> (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from talkmill.llm import conversation_tries, exact_dedup, fertility, length_packing, line_dedup, mixing, piece_codec, ppm, quotations, sharding, simhash_pivots, token_counts, vector_codes
from talkmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


#: Wanted shares of expected tokens.
MIX = {"good": 0.85, "plain": 0.14, "toxic": 0.01}


def op2_soft_membership_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates, _ = mixing.soft_mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIX)
    return rates.withColumnRenamed("id", "doc_id").drop("text_hash")


def op3_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.ppm_scores(table(spark, sf_dir, "documents"))


def op4_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.simhash_groups(table(spark, sf_dir, "documents"))


def op5_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_packing.packed(table(spark, sf_dir, "documents"))


def op6_heap_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), PIECES)


def op7_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judged(table(spark, sf_dir, "documents"), PIECES, RANKS)


def op8_trie_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_line_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op10_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = quotations.quoting_messages(table(spark, sf_dir, "conversations"))
    return quotations.linked_conversations(mails).withColumnsRenamed({"scope": "conv_id", "at": "turn"})


def op11_gnat_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(*vector_codes.vector_codes(table(spark, sf_dir, "embeddings")))


def op12_conversation_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_tries.turn_rows(table(spark, sf_dir, "conversations"))
    return conversation_tries.prefix_trie(conversation_tries.sharing_starts(turns)).drop("turn_id")


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(piece_codec.encoded(table(spark, sf_dir, "documents"), PIECES))


EXACT_DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER best = 1 AS kept, text_sha256
FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""

def _codes_sql(rounds: int = 4) -> str:
    """Product quantisation written out round by round: a full search where the operator searches a tree."""
    def assigned(books: str) -> str:
        return f"""SELECT vec_id, p, min(d * 256 + e) AS m FROM (
    SELECT vec_id, p, e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(a.x, b.x)])::BIGINT AS d FROM parts a JOIN {books} b USING (p)) GROUP BY 1, 2"""

    steps = []
    for i in range(rounds):
        steps.append(f"""a{i} AS ({assigned(f'b{i}')}),
b{i + 1} AS (SELECT b.p, b.e, coalesce(u.x, b.x) AS x FROM b{i} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS x FROM (
    SELECT p, m % 256 AS e, i, CAST(floor(sum(c) / count(*)::DOUBLE) AS BIGINT) AS c FROM (
      SELECT p, m, x[i] AS c, i FROM (SELECT p, m, x, unnest(range(1, len(x) + 1)) AS i FROM a{i} JOIN parts USING (vec_id, p))) GROUP BY 1, 2, 3) GROUP BY 1, 2) u USING (p, e))""")
    return f"""WITH kept AS (
  SELECT vec_id, label, [CAST(floor(1024 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT vec_id, p, v[p * w + 1:(p + 1) * w] AS x FROM (SELECT vec_id, v, len(v) // 4 AS w, unnest(range(4)) AS p FROM kept)),
b0 AS (SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 256),
{', '.join(steps)},
last AS ({assigned(f'b{rounds}')}),
codes AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(m % 256)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM last JOIN kept USING (vec_id) GROUP BY 1, 2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM codes"""


CONVERSATION_TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'id': id, 'words': words} ORDER BY turn NULLS FIRST, id) AS s,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(conv_id::VARCHAR, '')]),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 4 AS h
  FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.s[1:o.h], []), o.s[o.h + 1:]) AS s FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
starts AS (
  SELECT conv_id, len(s) AS size, d, array_to_string([t.id FOR t IN s[1:d]], '') AS path, CASE WHEN d > 0 THEN s[d].words ELSE 0 END AS words
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM starts GROUP BY path, d),
children AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
shaped AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
above AS (
  SELECT left(path, 32 * e) AS path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM shaped) GROUP BY 1)
SELECT s.conv_id, s.depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, a.n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, s.ends_sha256
FROM shaped s JOIN above a USING (path) LEFT JOIN nodes p ON s.depth > 0 AND p.path = left(s.path, 32 * (s.depth - 1))
"""

QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_histogram_shards": (op1_histogram_shards, None),
    "op2_soft_membership_mix": (op2_soft_membership_mix, None),
    "op3_ppm_scores": (op3_ppm_scores, None),
    "op4_pivot_simhash": (op4_pivot_simhash, None),
    "op5_length_buckets": (op5_length_buckets, None),
    "op6_heap_merge_counts": (op6_heap_merge_counts, None),
    "op7_tokeniser_fertility": (op7_tokeniser_fertility, None),
    "op8_trie_owners": (op8_trie_owners, EXACT_DEDUP_SQL),
    "op9_line_similarity_join": (op9_line_similarity_join, None),
    "op10_quotation_threads": (op10_quotation_threads, None),
    "op11_gnat_vector_codes": (op11_gnat_vector_codes, _codes_sql()),
    "op12_conversation_tries": (op12_conversation_tries, CONVERSATION_TRIE_SQL),
    "op13_piece_codec": (op13_piece_codec, None),
}
