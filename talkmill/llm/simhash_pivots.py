"""SimHash near-duplicates over pivot distance tables.

For every different fingerprint the Hamming distances to a fixed set of reference fingerprints are
precomputed. Two kinds of references serve two steps:

* Thermometers: references whose ones fill a block of bits from its start. Fingerprints that agree
  on a block have the same distance steps along the block's thermometers. Of 6 blocks at most 3
  can change within 3 bits, so linked fingerprints share the steps of some 3 blocks: these steps are
  the join key, 32 bits wide, one of 20 per fingerprint.
* Scattered references. By the triangle inequality linked fingerprints differ by at most 3 in each
  distance; pairs whose maximum difference is larger are discarded, one coordinate after the other.

Survivors are verified on the fingerprints. Equal fingerprints are one node from the start, and of
the links inside a bucket a spanning forest is kept: each fingerprint is compared only with those not
reached yet, so a bucket full of near copies costs about one look at each. A task holds the fingerprints of the
bucket it works on, 8 bytes each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from talkmill.llm.common import by_value, free_name, staged
from talkmill.llm.components import connected

by_value(__name__)

RADIUS = 3
WIDTH = 3
SEED = 42
#: Blocks of bits (first, length), most significant bit first.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
SHARED = list(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS))
#: Shingles hashed at a time.
CHUNK = 1 << 15


def _thermometers(first: int, length: int) -> np.ndarray:
    """References with the first 0..length bits of a block set."""
    return np.array([sum(1 << (63 - first - i) for i in range(n)) for n in range(length + 1)], np.uint64)


SCATTERED = np.array([xxhash.xxh64_intdigest(b"reference %d" % i, SEED) for i in range(24)], np.uint64)


def distances(fingerprints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Pivot table: one row per fingerprint, one column per reference."""
    return np.bitwise_count(fingerprints[:, None] ^ references[None, :]).astype(np.int16)


def fingerprint(text: str | None) -> bytes:
    """8 bytes, most significant first; see the contract in ``simhash_groups``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    if len(words) < WIDTH:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[WIDTH - 1:].tolist()
    starts = [0, *(ends[:len(words) - WIDTH] + 1).tolist()]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for i in range(0, len(starts), CHUNK):
        hashes = b"".join([digest(line[s:e], SEED) for s, e in zip(starts[i:i + CHUNK], stops[i:i + CHUNK])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(starts)).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = b"".join(map(fingerprint, batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.frombuffer(prints, ">i8").astype(np.int64))], names=["doc_id", "fp"],
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join keys (choice of blocks, steps along their thermometers, fingerprint)."""
    for batch in batches:
        for start in range(0, batch.num_rows, 20_000):
            part = batch.column(0).slice(start, 20_000)
            prints = part.to_numpy(zero_copy_only=False).astype(np.int64)
            steps = []
            for block in BLOCKS:
                table = distances(prints.view(np.uint64), _thermometers(*block))
                down = (np.diff(table, axis=1) < 0).astype(np.int64)
                steps.append(down @ (1 << np.arange(block[1])[::-1]))
            for number, chosen in enumerate(SHARED):
                key = np.zeros(len(prints), np.int64)
                for b in chosen:
                    key = (key << BLOCKS[b][1]) | steps[b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(prints), number, np.int32)), pa.array(key), part], names=["choice", "key", "fp"],
                )


def spanning_links(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links at ``radius`` among different fingerprints."""
    table = distances(prints, SCATTERED)
    from_, to = [], []
    waiting = np.arange(len(prints))
    while len(waiting):
        frontier, waiting = [waiting[0]], waiting[1:]
        while frontier and len(waiting):
            at = frontier.pop()
            near = np.arange(len(waiting))
            for column in range(table.shape[1]):
                near = near[np.abs(table[waiting[near], column] - table[at, column]) <= radius]
                if not len(near):
                    break
            if len(near):
                near = near[np.bitwise_count(prints[waiting[near]] ^ prints[at]) <= radius]
            if len(near):
                reached = waiting[near]
                from_.append(np.full(len(reached), at))
                to.append(reached)
                frontier.extend(reached.tolist())
                waiting = np.delete(waiting, near)
    none = np.zeros(0, np.int64)
    return (np.concatenate(from_), np.concatenate(to)) if from_ else (none, none)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside the buckets of a partition sorted by (choice, key)."""
    kept: list[np.ndarray] = []
    last = None

    def solve(prints: np.ndarray) -> pa.RecordBatch | None:
        i, j = spanning_links(prints.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(prints[i]), pa.array(prints[j])], names=["a", "b"]) if len(i) else None

    for batch in batches:
        choice, key, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(key):
            continue
        fresh = np.flatnonzero((np.diff(choice) != 0) | (np.diff(key) != 0)) + 1
        runs = np.concatenate([[0], fresh, [len(key)]])
        # Only runs of at least two rows, and those at the edges of a batch, are looked at.
        for r in range(len(runs) - 1):
            start, stop = runs[r], runs[r + 1]
            first, final = r == 0, r == len(runs) - 2
            if not first and not final and stop - start < 2:
                continue
            name = (choice[start], key[start])
            if name != last:
                if kept and (out := solve(np.concatenate(kept))) is not None:
                    yield out
                kept, last = [], name
            kept.append(prints[start:stop].astype(np.int64))
    if kept and (out := solve(np.concatenate(kept))) is not None:
        yield out


def linked(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints within the radius; ``prints`` has distinct ``fp``."""
    return (
        prints.select("fp").mapInArrow(_keys, "choice int, key long, fp long")
        .repartition("choice", "key").sortWithinPartitions("choice", "key")
        .mapInArrow(_links, "a long, b long").distinct()
    )


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id).

    Words are lower-cased (A-Z) and cut at white space; every 3-word shingle, repeats included, is
    hashed by XXH64; a bit is 1 if set in over half of the hashes. Fewer words are one shingle; a
    text without words, or null, has fingerprint zero and links like any other. Fingerprints link
    at 3 or fewer differing bits; the component is named by the smallest id reachable (null only if
    all its ids are null). Every row comes back, repeated ones too; other columns are ignored.
    """
    rows = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = connected(linked(nodes))
    rooted = staged(
        nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")),
        "fingerprint-roots",
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grouped: Callable[..., DataFrame] = simhash_groups) -> DataFrame:
    """The documents whose id names their component, with all their columns.

    Rows with a null id stay only if their component has no other id. Of rows repeating the
    naming id all stay that are equal to it in id: ids are expected to be unique.
    """
    groups = grouped(docs, id_col, text_col)
    name = free_name(docs.columns, "stays")
    stay = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col(name)), "left_semi")
