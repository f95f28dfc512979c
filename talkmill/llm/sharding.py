"""Shards of near equal bytes by histogram sort.

Rows get a two-part key: hash of the text, then hash of the id, so equal texts are neighbours.
Candidate boundaries (probes) are laid over the key range and the exact bytes below each are
counted over all partitions; the interval around every wanted splitter is then divided anew until
the bytes left inside meet the tolerance. A text that alone exceeds the tolerance is divided by the
second part of the key. Then every row goes once to its shard.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from talkmill.llm.common import cells_for, numbered, staged

#: Keys are the upper 62 bits of a hash, so that interval arithmetic stays inside a long.
KEY_RANGE = 1 << 62
#: Probes inside one interval and round.
PROBES = 64


def key_of(value: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 2)


def _refine(rows: DataFrame, key: str, size: str, total: int, targets: list[int], tolerance: int) -> list[tuple[int, int, int, int, int]]:
    """For each wanted number of bytes the interval (low, high, bytes below low, bytes below high, rows).

    ``low <= splitter < high`` holds the target; an interval is done when it holds no more than
    ``tolerance`` bytes or one row, or is a single key. A round is one aggregate of at most
    ``len(targets) * PROBES`` sums.
    """
    found = {t: (0, KEY_RANGE, 0, total, 2) for t in targets}
    while True:
        open_ = sorted({v for v in found.values() if v[1] - v[0] > 1 and v[4] > 1 and v[3] - v[2] > tolerance})
        if not open_:
            return [found[t] for t in targets]
        # Intervals of different targets are equal or apart. Cells of interval i are i*PROBES, ...
        steps = [-(-(high - low) // PROBES) for low, high, *_ in open_]
        cell = F.coalesce(*[
            F.when((F.col(key) >= low) & (F.col(key) < high), F.expr(f"(`{key}` - {low}) div {step} + {i * PROBES}"))
            for i, ((low, high, *_), step) in enumerate(zip(open_, steps))
        ])
        sums = {
            r["cell"]: (int(r["bytes"]), r["n"])
            for r in rows.select(cell.alias("cell"), size).filter("cell IS NOT NULL").groupBy("cell")
            .agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).collect()
        }
        for i, (interval, step) in enumerate(zip(open_, steps)):
            low, high, below, *_ = interval
            edges, at = [], below
            for p in range(PROBES):
                start = low + p * step
                if start >= high:
                    break
                held, n = sums.get(i * PROBES + p, (0, 0))
                edges.append((start, min(high, start + step), at, at + held, n))
                at += held
            for t in [t for t in targets if found[t] == interval]:
                found[t] = next(e for e in edges if e[2] <= t < e[3] or e is edges[-1])


def splitters(rows: DataFrame, size: str, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Composite keys (first, second) at which shard 1, 2, ... begin; rows has columns k1, k2."""
    total = int(rows.agg(F.sum(size)).first()[0] or 0)
    allowed = int(tolerance * total / shards)
    targets = [total * j // shards for j in range(1, shards)]
    edges = []
    for target, (low, high, below, above, n) in zip(targets, _refine(rows, "k1", size, total, targets, allowed)):
        if min(target - below, above - target) <= allowed or n <= 1:
            edges.append((low, 0) if target - below <= above - target else (high, 0))
            continue
        # One text holds more than the tolerance: the shards part inside its copies.
        copies = rows.filter(F.col("k1") == low)
        (low2, high2, below2, above2, _), = _refine(copies, "k2", size, above - below, [target - below], allowed)
        edges.append((low, low2 if target - below - below2 <= above2 - (target - below) else high2))
    return sorted(edges)


def assigned(k1: Column, k2: Column, edges: list[tuple[int, int]]) -> Column:
    """Shard of a key: the number of splitters at or below it."""
    past = [((k1 > a) | ((k1 == a) & (k2 >= b))).cast("int") for a, b in edges]
    return reduce(lambda x, y: x + y, past, F.lit(0))


def shard_by_bytes(
    docs: DataFrame, shards: int = 8, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    ``size`` is the UTF-8 bytes of the text plus 1; a null text has no bytes and the checksum of
    the empty string. Shards differ from an equal share by at most the tolerance (a share of the
    shard) on either side, as far as single rows allow. Equal texts stay together unless a splitter
    falls into a text that alone exceeds the tolerance. Slots count from 0 without gaps. Rows that
    repeat an id are rows of their own; an empty table gives an empty result.
    """
    text, id_ = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    slim = staged(docs.select(
        id_.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        key_of(text).alias("k1"), key_of(id_.cast("string")).alias("k2"),
    ), "shard-keys")
    edges = splitters(slim, "size", shards, tolerance)
    cells = cells_for(slim.count(), shards)
    placed = slim.withColumn("shard", assigned(F.col("k1"), F.col("k2"), edges)).withColumn("_cell", F.pmod(F.xxhash64("doc_id", "k1"), F.lit(cells)))
    return numbered(placed, "shard", "_cell", ["k1", "k2", "doc_id"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
