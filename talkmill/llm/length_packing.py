"""Packing by optimal length buckets.

Texts are cut into pieces of at most ``max_length`` tokens (nothing is dropped). Dynamic
programming over the global length histogram chooses the bucket boundaries with the least padding,
and batches of a fixed token budget form inside each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from talkmill.llm.common import cells_for, numbered, staged


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Boundaries (each a length that occurs, the last the largest) with the least total padding.

    A row of length l in a bucket with boundary b is padded by b - l. Exact in integers; time grows
    with buckets x lengths^2, on a histogram that has at most ``max_length`` entries.
    """
    size = np.array(lengths, np.int64)
    n = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
    tokens = np.concatenate([[0], np.cumsum(size * np.array(counts, np.int64))])
    m = len(size)
    if not m:
        return []
    # least[j]: padding of the first j lengths; one bucket holds lengths i+1..j.
    least = np.concatenate([[0], size * n[1:] - tokens[1:]])
    cuts = []
    for _ in range(min(buckets, m) - 1):
        new, cut = least.copy(), np.full(m + 1, -1)
        for j in range(1, m + 1):
            cost = least[:j] + tokens[:j] - size[j - 1] * n[:j]
            i = int(cost.argmin())
            total = int(cost[i]) + int(size[j - 1] * n[j] - tokens[j])
            if total < new[j]:
                new[j], cut[j] = total, i
        cuts.append(cut)
        if (new == least).all():
            break
        least = new
    ends, j = [], m
    for cut in reversed(cuts):
        if cut[j] > 0:
            ends.append(int(size[j - 1]))
            j = cut[j]
    ends.append(int(size[j - 1]))
    return sorted(ends)


def boundary_of(length: Column, boundaries: list[int]) -> Column:
    """The smallest boundary that holds a length."""
    return F.coalesce(*[F.when(length <= b, F.lit(b)) for b in boundaries]) if boundaries else F.lit(None).cast("int")


def packed(
    docs: DataFrame, buckets: int = 16, max_length: int = 4096, budget: int = 65_536, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: (doc_id, piece, start, n_tokens, bucket, batch, slot, padding).

    Tokens are the words of a text and one end, so a null or empty text is one piece of one token.
    ``bucket`` is the padded length; a batch holds ``budget // bucket`` pieces of one bucket, the last
    of each bucket the rest; ``slot`` is the place inside the batch. Pieces enter batches in the order
    of a hash of their id. The histogram, at most ``max_length`` numbers, is all the driver gets.
    Rows that repeat an id are packed each; an empty table gives an empty result.
    """
    if max_length > budget:
        raise ValueError("a batch must hold at least one piece")
    id_ = F.col(f"`{id_col}`")
    n = F.coalesce(F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1
    whole = docs.select(id_.alias("doc_id"), n.cast("long").alias("_n"))
    pieces = staged(
        whole.select("doc_id", "_n", F.explode(F.sequence(F.lit(0), F.expr(f"cast((_n - 1) div {max_length} as int)"))).alias("piece"))
        .withColumn("start", F.col("piece").cast("long") * max_length)
        .select("doc_id", "piece", "start", F.least(F.col("_n") - F.col("start"), F.lit(max_length)).cast("int").alias("n_tokens")), "pieces",
    )
    histogram = sorted((r["n_tokens"], r["count"]) for r in pieces.groupBy("n_tokens").count().collect())
    ends = best_boundaries([x for x, _ in histogram], [c for _, c in histogram], buckets)
    cells = cells_for(sum(c for _, c in histogram), max(1, len(ends)), least=64)
    placed = pieces.withColumn("bucket", boundary_of(F.col("n_tokens"), ends)).withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)))
    rank = numbered(placed, "bucket", "_cell", ["doc_id", "piece", "n_tokens"], "_rank")
    return rank.select(
        "doc_id", "piece", "start", "n_tokens", "bucket", F.expr(f"_rank div ({budget} div bucket)").alias("batch"),
        F.expr(f"cast(_rank % ({budget} div bucket) as int)").alias("slot"), (F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )
