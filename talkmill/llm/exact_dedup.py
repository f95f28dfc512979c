"""Exact duplicates by Patricia-trie owners.

Every task first puts its own texts into a compressed radix trie, so copies leave a task once.
What is left is dealt by (length, content hash) to owner partitions and sorted by the same key.
An owner inserts the full byte strings into its trie; terminal nodes keep the surviving row and
the number of rows. Copies are neighbours in the sort, so when the trie has grown to its budget
and the key changes, all subtrees inserted so far are final and leave memory; what waits on disk
is the rest of the sorted rows, which Spark's sort spills. Equality is decided by bytes in the
trie, never by the hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from talkmill.llm.common import BLANKS, by_value

by_value(__name__)

#: Bytes of labels a task keeps in its trie before finished subtrees leave it.
TRIE_BYTES = 24 << 20
#: Bytes of text in one Arrow batch handed to Spark.
BATCH_BYTES = 4 << 20

ENTRY = "n_bytes long, content_hash long, body binary, code_points long, id long, n_rows long"
CLASS = "text_sha256 string, keep_id long, group_size long"
DIGEST = "doc_id long, code_points long, text_sha256 string"


def normalised(text: str | None) -> bytes:
    """UTF-8 bytes without white space; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(None, BLANKS)


class Survivor:
    """Best row and row count of one text: most code points, then smallest id, nulls last."""

    __slots__ = ("code_points", "id", "n")

    def __init__(self, code_points: int, id_: int | None, n: int):
        self.code_points, self.id, self.n = code_points, id_, n

    def rank(self) -> tuple:
        return -self.code_points, self.id is None, self.id or 0

    def merge(self, other: Survivor) -> None:
        if other.rank() < self.rank():
            self.code_points, self.id = other.code_points, other.id
        self.n += other.n


class RadixTrie:
    """Compressed trie over byte strings. A node is [label, children by first byte, survivor]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.bytes = 0

    def insert(self, key: bytes, entry: Survivor) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, entry]
                self.bytes += len(key) - at + 400
                return
            label = child[0]
            if not key.startswith(label, at):
                shared = _shared(label, key, at)
                # The label splits where the two strings part; the lower half keeps the subtree.
                lower = [label[shared:], child[1], child[2]]
                child[0], child[1], child[2] = label[:shared], {label[shared]: lower}, None
                self.bytes += 400
                label = child[0]
            node, at = child, at + len(label)
        if node[2] is None:
            node[2] = entry
        else:
            node[2].merge(entry)

    def terminals(self) -> Iterator[tuple[bytes, Survivor]]:
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            key = prefix + node[0]
            if node[2] is not None:
                yield key, node[2]
            stack.extend((key, child) for child in node[1].values())


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[:middle] == key[at:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _batches(rows: Iterable[tuple], schema: pa.Schema, weigh: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of bounded size; ``weigh`` is the column whose bytes count."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 if weigh is None else 64 + len(row[weigh])
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_ENTRY = pa.schema([("n_bytes", pa.int64()), ("content_hash", pa.int64()), ("body", pa.binary()), ("code_points", pa.int64()), ("id", pa.int64()), ("n_rows", pa.int64())])
_CLASS = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("code_points", pa.int64()), ("text_sha256", pa.string())])


def _own_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per different text of a task (or of each trie budget's worth of it)."""
    def leave(trie: RadixTrie) -> Iterator[tuple]:
        for key, s in trie.terminals():
            yield len(key), xxhash.xxh64_intdigest(key) - (1 << 63), key, s.code_points, s.id, s.n

    def rows() -> Iterator[tuple]:
        trie = RadixTrie()
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                trie.insert(normalised(text), Survivor(len(text or ""), id_, 1))
                if trie.bytes > TRIE_BYTES:
                    yield from leave(trie)
                    trie = RadixTrie()
        yield from leave(trie)

    yield from _batches(rows(), _ENTRY, weigh=2)


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of an owner partition, whose rows arrive sorted by (length, hash)."""
    def leave(trie: RadixTrie) -> Iterator[tuple]:
        for key, s in trie.terminals():
            yield hashlib.sha256(key).hexdigest(), s.id, s.n

    def rows() -> Iterator[tuple]:
        trie, last = RadixTrie(), None
        for batch in batches:
            for n_bytes, content, key, points, id_, n in zip(*(c.to_pylist() for c in batch.columns)):
                if trie.bytes > TRIE_BYTES and last != (n_bytes, content):
                    yield from leave(trie)
                    trie = RadixTrie()
                trie.insert(key, Survivor(points, id_, n))
                last = (n_bytes, content)
        yield from leave(trie)

    yield from _batches(rows(), _CLASS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(t or "") for t in texts], pa.int64()),
            pa.array([hashlib.sha256(normalised(t)).hexdigest() for t in texts]),
        ], schema=_DIGEST)


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per different text: (text_sha256, keep_id, group_size)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    owners = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return (
        rows.mapInArrow(_own_copies, ENTRY)
        .repartition(int(owners), "n_bytes", "content_hash").sortWithinPartitions("n_bytes", "content_hash")
        .mapInArrow(_owned, CLASS)
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when they are identical without white space; null counts as empty. Of equal
    texts the row with the most code points in the original, then the smallest id, stays; null ids
    come last. Of rows that repeat an id with an equal text exactly one can stay. An empty table
    gives an empty result; extra columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    digests = rows.mapInArrow(_digests, DIGEST)
    repeat = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy(F.desc("code_points")))
    return (
        digests.withColumn("_repeat", repeat)
        .join(text_classes(docs, id_col, text_col), "text_sha256")
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_repeat") == 1)).alias("kept"), "text_sha256")
    )
