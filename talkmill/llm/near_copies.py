"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from the pivot tables of :mod:`talkmill.llm.simhash_pivots`: texts whose SimHash
fingerprints are within its radius. Few pairs at 0.8 are that close, so texts that share one of 24
bands of five minima (a pair at 0.8 shares one with probability 0.9999) are candidates as well.
Pairs are verified on the shingles. Texts with equal sets are one node.

All candidates are decided, in two steps. First every text is compared with the first text of each of
its bands and of its fingerprint, and with what a spanning forest of the fingerprints links: few pairs
a text, which join nearly all groups. Then the candidates whose ends are still apart are compared,
each in the first bucket its ends share. A bucket is cut into blocks of bounded size and two blocks
meet in a task, so a bucket in which few texts match takes the square of its size, but over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from talkmill.llm.common import by_value, staged
from talkmill.llm.components import connected
from talkmill.llm.simhash_pivots import BLOCKS, RADIUS, SHARED, _keys, fingerprint, linked

by_value(__name__)

WIDTH = 5
LEAST_JACCARD = 0.8
SEED = 42
BANDS, ROWS = 24, 5
#: Shingles worked on at a time.
CHUNK = 1 << 12
#: Bytes of shingles in a block of a bucket.
BLOCK_BYTES = 4 << 20
#: The bits of a fingerprint that each choice of blocks takes.
MASKS = np.array([sum(((1 << n) - 1) << (64 - first - n) for first, n in (BLOCKS[b] for b in chosen)) for chosen in SHARED], np.uint64)
_RANDOM = np.random.default_rng(SEED)
FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted different hashes of the shingles; fewer words are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    width = min(WIDTH, len(words))
    starts = [0, *(e + 1 for e in ends[:len(words) - width])]
    return np.unique(np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, ends[width - 1:])), np.uint64, len(starts)))


def node_of(found: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(found.tobytes(), SEED)


def bands_of(found: np.ndarray) -> list[int]:
    """One number for each band of minima; none without shingles."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), CHUNK):
        least = np.minimum(least, (found[i:i + CHUNK, None] * FACTORS + SHIFTS).min(axis=0))
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[8 * ROWS * b:8 * ROWS * (b + 1)], b) - (1 << 63) for b in range(BANDS)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        sets, prints = [shingles(t) for t in texts], b"".join(map(fingerprint, texts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(node_of, sets), pa.string()), pa.array([bands_of(s) for s in sets], pa.list_(pa.int64())),
             pa.array(np.frombuffer(prints, ">i8").astype(np.int64))],
            names=["doc_id", "node", "bands", "fp"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            sets = [shingles(t) for t in batch.column(0).slice(start, 200).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(node_of, sets), pa.string()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "held"],
            )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yes = []
        for x, y in zip(batch.column(2), batch.column(3)):
            left, right = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(left, right, assume_unique=True))
            yes.append(both >= LEAST_JACCARD * (len(left) + len(right) - both))
        yield batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))


def _compared(bucket: pa.Table) -> pa.Table:
    """Links (a, b) that connect the roots of all matching pairs whose first bucket this is; two blocks of a bucket, or one, meet."""
    kind, sides = bucket["kind"][0].as_py(), bucket["side"].to_numpy()
    sets = [np.frombuffer(v.as_py(), np.uint64) for v in bucket["held"]]
    sizes = np.array([len(s) for s in sets])
    names, roots = np.unique(np.array(bucket["root"].to_pylist(), object), return_inverse=True)
    prints = bucket["fp"].fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
    bands = [bands_of(s) for s in sets]
    banded = np.array([bool(b) for b in bands])
    keys = np.array([b or [0] * BANDS for b in bands])[:, :kind]
    words, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    numbers, marked = np.split(numbers, np.cumsum(sizes)[:-1]), np.zeros(len(words), bool)
    group, a, b = np.arange(len(names)), [], []
    others = np.flatnonzero(sides == 1)
    for x in np.flatnonzero(sides == 0):
        ys = others if len(others) else np.arange(x + 1, len(sets))
        ys = ys[group[roots[ys]] != group[roots[x]]]
        ys = ys[np.minimum(sizes[ys], sizes[x]) >= LEAST_JACCARD * np.maximum(sizes[ys], sizes[x])]
        if kind >= BANDS:
            apart = prints[ys] ^ prints[x]
            earlier = ((apart[:, None] & MASKS[:kind - BANDS]) == 0).any(axis=1)
            ys = ys[(np.bitwise_count(apart) <= RADIUS) & ~earlier]
        ys = ys[~((keys[ys] == keys[x]).any(axis=1) & banded[ys] & banded[x])]
        if not len(ys):
            continue
        marked[numbers[x]] = True
        both = np.array([np.count_nonzero(marked[numbers[y]]) for y in ys])
        marked[numbers[x]] = False
        for y in ys[both >= LEAST_JACCARD * (sizes[ys] + sizes[x] - both)]:
            if group[roots[y]] != group[roots[x]]:
                group[group == group[roots[y]]] = group[roots[x]]
                a.append(names[roots[x]])
                b.append(names[roots[y]])
    return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})


def pivot_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First candidates (a, b) among the nodes of (node, fp): the first node of a fingerprint with the others and over a spanning forest of the links.

    Besides the (fp, node) of all candidates: fingerprints of several nodes or with another one within the radius.
    """
    named = rows.select("fp", "node").distinct()
    first = staged(named.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "first-of-print")
    equal = named.join(first.filter("n > 1"), "fp").filter("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = [first.select(F.col("fp").alias(end), F.col("first").alias(f"_{end}")) for end in "ab"]
    forest = staged(linked(first), "near-prints")
    close = forest.join(ends[0], "a").join(ends[1], "b").filter("_a <> _b").select("_a", "_b")
    met = forest.select(F.col("a").alias("fp")).union(forest.select("b")).union(first.filter("n > 1").select("fp")).distinct()
    return equal.union(close), staged(named.join(met, "fp"), "met-prints")


def band_members(rows: DataFrame) -> DataFrame:
    """(band, key, node, first) of the bands that several nodes share."""
    posted = staged(rows.select("node", F.posexplode("bands").alias("band", "key")).distinct(), "bands")
    first = posted.groupBy("band", "key").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return staged(posted.join(first, ["band", "key"]), "shared-bands")


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that match, by the sets of their nodes."""
    return (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("_x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("held").alias("_y")), "b")
        .select("a", "b", "_x", "_y").mapInArrow(_verified, "a string, b string")
    )


def links_left(shared: DataFrame, prints: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Links (a, b) among the roots, from all candidates of (band, key, node) and (fp, node) whose roots differ.

    Buckets are the bands and, numbered from there on, the choices of the pivot tables.
    """
    pivots = prints.select("fp").distinct().mapInArrow(_keys, "choice int, key long, fp long").join(prints, "fp")
    either = shared.select(F.col("band").alias("kind"), "key", "node", F.lit(None).cast("long").alias("fp")).union(
        pivots.select(F.col("choice") + BANDS, "key", "node", "fp"))
    known = sets.select("node", (F.octet_length("held") + 256).cast("long").alias("_size")).join(roots, "node", "left")
    members = staged(either.join(known.withColumn("root", F.coalesce("root", "node")), "node"), "near-members")
    # Of buckets with the same members the first is enough.
    same_members = [F.bit_xor(F.xxhash64("node", "fp", F.lit(i))).alias(f"_{i}") for i in range(2)]
    mixed = (
        members.groupBy("kind", "key").agg(F.min("root").alias("_least"), F.max("root").alias("_most"), F.sum("_size").alias("_bytes"), F.count("*").alias("_n"), *same_members)
        .filter("_least <> _most").groupBy("_n", "_0", "_1", "_bytes").agg(F.min(F.struct("kind", "key")).alias("_first"))
        .select("_first.*", F.ceil(F.col("_bytes") / BLOCK_BYTES).cast("int").alias("_blocks"))
    )
    own, other = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = members.join(mixed, ["kind", "key"]).withColumn("_own", own).withColumn("_other", other).select(
        "kind", "key", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"),
        (F.col("_own") > F.col("_other")).cast("int").alias("side"), "node", "fp", "root")
    return dealt.join(sets, "node").groupBy("kind", "key", "_i", "_j").applyInArrow(_compared, "a string, b string").distinct()


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, component_id), the smallest id reachable over links.

    Words are lower-cased (A-Z) and cut at white space. Texts without words, or null, are one group. The
    component is null only if all its ids are null. Every row comes back, repeated ones too.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = staged(texts.mapInArrow(_sketches, "doc_id long, node string, bands array<long>, fp long"), "near-sketches")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    shared, (close, prints) = band_members(rows), pivot_pairs(rows)
    either = close.union(shared.filter("first <> node").select("first", "node")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = staged(either.distinct(), "near-pairs")
    wanted = shared.select("node").union(prints.select("node")).distinct()
    sets = staged(
        texts.select("text").mapInArrow(_sets, "node string, held binary").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("held").alias("held")),
        "near-sets",
    )
    roots = connected(links(pairs, sets))
    onward = connected(links_left(shared, prints, sets, roots)).select(F.col("node").alias("_root"), F.col("root").alias("_onward"))
    first = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("_root"))
    rooted = staged(first.join(onward, "_root", "left").select("node", "least", F.coalesce("_onward", "_root").alias("root")), "near-roots")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "node").join(rooted.join(names, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
