"""Language-model scores by prediction by partial matching.

The trie of byte contexts up to ORDER is counted over all training texts. A byte is predicted by the
longest context seen; a context that lacks it escapes (method C: as many escapes as different
symbols) to the next shorter one, where symbols of the longer context are excluded. A text's score
is the sum of the log probabilities of its bytes.

A probability depends only on the byte and its ORDER predecessors, so it is computed once per
different gram. Texts are packed into blocks of some megabytes. A block sends its different grams
(a few per cent of its bytes) by slice of the trie; the slice, a subtree under some two-byte
contexts, sums the counts of all blocks, computes the probabilities and answers every block with those
it asked for. Nothing holds the whole trie; orders 0 and 1 are a table of fixed size. Word counts
for the base score travel the same way, words as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from talkmill.llm.common import by_value, combined, pieces_of, staged

by_value(__name__)

ORDER = 5
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 6 << 20
#: Slices of the trie and of the words.
SLICES = 512
GRAM, WORD, PAIRS = 0, 1, 2
#: Begins and ends every text; words can't contain it.
END = b"\n"

BLOCK = "ids array<bigint>, held array<boolean>, sizes array<bigint>, body binary"
REQUEST = "kind int, slice int, block long, codes binary, counts binary, piece int, content binary"
_REQUEST = {"kind": pa.int32(), "slice": pa.int32(), "block": pa.int64(), "codes": pa.binary(), "counts": pa.binary(), "piece": pa.int32(), "content": pa.binary()}


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; the end of the text is one more token."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, held, sizes, bodies, size = [], [], [], [], 0
    squeeze = zstandard.ZstdCompressor(level=3)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int64())),
            pa.array([squeeze.compress(b"".join(bodies))], pa.binary()),
        ], names=["ids", "held", "sizes", "body"])

    for batch in batches:
        for id_, out, text in zip(*(c.to_pylist() for c in batch.columns)):
            body = b" ".join(tokens(text)) + END
            if ids and size + len(body) > BLOCK_BYTES:
                yield row()
                ids, held, sizes, bodies, size = [], [], [], [], 0
            ids.append(id_)
            held.append(out)
            sizes.append(len(body))
            bodies.append(body)
            size += len(body)
    if ids:
        yield row()


class Block:
    """A block's bytes, grams and words. Each text is preceded by ORDER ends."""

    def __init__(self, sizes: list[int], body: bytes):
        raw = zstandard.ZstdDecompressor().decompress(body)
        self.sizes, cuts = np.array(sizes, np.int64), np.cumsum([0, *sizes])
        self.texts = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        padded = np.frombuffer(END * ORDER + (END * ORDER).join(self.texts), np.uint8)
        codes = np.zeros(len(padded) - ORDER, np.int64)
        for k in range(ORDER + 1):
            codes <<= 8
            codes |= padded[k:len(codes) + k]
        # Grams that end inside the padding before a text are none of its own.
        own = np.zeros(len(codes), bool)
        starts = cuts[:-1] + np.arange(len(sizes)) * ORDER
        for s, n in zip(starts.tolist(), sizes):
            own[s:s + n] = True
        self.codes = codes[own]

    def words(self) -> list[list[bytes]]:
        return [t.split() for t in self.texts]


def word_codes(words: list[list[bytes]], memory: dict[bytes, int]) -> np.ndarray:
    if len(memory) > 500_000:
        memory.clear()
    hashed = xxhash.xxh64_intdigest
    for doc in words:
        for w in set(doc).difference(memory):
            memory[w] = hashed(w) - (1 << 63)
    return np.fromiter(map(memory.__getitem__, chain.from_iterable(words)), np.int64)


def _sliced(kind: int, codes: np.ndarray) -> np.ndarray:
    """Slice of each code: of a gram by its two last context bytes, so a subtree stays together."""
    part = (codes >> 8) & 0xFFFF if kind == GRAM else codes
    return ((part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % SLICES


def different(codes: np.ndarray) -> np.ndarray:
    """Different codes in ascending order: one sort, which is quicker here than the hash table of numpy.unique."""
    ordered = np.sort(codes)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def counted(codes: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order of slice-independent value and how often each is in training texts."""
    unique, learned = different(codes), np.sort(codes[train])
    begins = np.searchsorted(learned, unique)
    return unique, np.diff(begins, append=len(learned))


def placed(codes: np.ndarray, unique: np.ndarray) -> np.ndarray:
    """Where each gram of a block stands among its different ones.

    The two halves of a gram are numbered among the halves present; both numbers and the gram's
    position, packed into one number, are sorted at once. A binary search per gram costs several times as much.
    """
    half, step = (1 << 24) - 1, 1 << 20
    present = np.zeros(1 << 24, bool)
    present[unique >> 24] = present[unique & half] = True
    number = np.cumsum(present, dtype=np.int32)
    kinds, places = int(number[-1]).bit_length(), len(codes).bit_length()
    out = np.empty(len(codes), np.int64)
    if 2 * kinds + places > 63:
        for s in range(0, len(codes), step):
            out[s:s + step] = np.searchsorted(unique, codes[s:s + step])
        return out
    packed = np.empty(len(codes), np.int64)
    for s in range(0, len(codes), step):
        part = codes[s:s + step]
        both = (number[part >> 24].astype(np.int64) << kinds) | number[part & half]
        packed[s:s + step] = (both << places) | np.arange(s, s + len(part))
    del number, present
    packed.sort()
    rank, last = 0, packed[0] >> places
    for s in range(0, len(codes), step):
        part = packed[s:s + step]
        gram = part >> places
        stands = rank + np.cumsum(np.diff(gram, prepend=last) != 0)
        out[part & ((1 << places) - 1)] = stands
        rank, last = stands[-1], gram[-1]
    return out


def by_slice(kind: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that brings sorted codes together by slice, the slices present, and where each begins."""
    slice_ = _sliced(kind, codes)
    # Numbers of 16 bits are dealt by their digits.
    order = np.argsort(slice_.astype(np.uint16), kind="stable")
    sizes = np.bincount(slice_, minlength=SLICES)
    present = np.flatnonzero(sizes)
    return order, present, (np.cumsum(sizes) - sizes)[present]


def _squeeze(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(array.tobytes())


def _expand(content: bytes, dtype=np.int64) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(content), dtype)


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs, memory = np.zeros(1 << 16, np.int64), {}
    for batch in batches:
        for block, held, sizes, body in zip(*(c.to_pylist() for c in batch.columns)):
            own = Block(sizes, body)
            train = ~np.array(held, bool)
            words = own.words()
            for kind, codes, lengths in (
                (GRAM, own.codes, own.sizes), (WORD, word_codes(words, memory), np.array([len(w) for w in words], np.int64)),
            ):
                learned = np.repeat(train, lengths)
                if kind == GRAM:
                    pairs += np.bincount(codes[learned] & 0xFFFF, minlength=1 << 16)
                unique, counts = counted(codes, learned)
                order, present, start = by_slice(kind, unique)
                rows = list(zip(present.tolist(), np.split(unique[order], start[1:]), np.split(counts[order], start[1:]))) if len(unique) else []
                columns = {
                    "kind": [kind] * len(rows), "slice": [r[0] for r in rows], "block": [block] * len(rows),
                    "codes": [_squeeze(np.diff(r[1], prepend=0)) for r in rows], "counts": [_squeeze(r[2]) for r in rows],
                }
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[c], t) if c in columns else pa.nulls(len(rows), t) for c, t in _REQUEST.items()], names=list(_REQUEST),
                    )
    yield from pieces_of(pairs, list(_REQUEST), _REQUEST)


def log_probabilities(codes: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each gram after the others.

    ``codes`` are different and sorted grams, all grams that share two-byte contexts with any of them;
    ``pairs`` counts (byte before, byte) over all training texts.
    """
    order1 = pairs.reshape(256, 256)
    order0 = order1.sum(axis=0)
    logp, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
    longer_total = longer_kinds = np.zeros(len(codes))
    for k in range(ORDER, -1, -1):
        # Count of (context, byte), count and number of symbols of the context, per gram.
        if k >= 2:
            keys, which = np.unique(codes & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            c = np.bincount(which, counts, len(keys))
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.bincount(of, c, len(contexts)), np.bincount(of, c > 0, len(contexts))
            seen, total, kinds = c[which], total[of][which], kinds[of][which]
        else:
            symbol, before = codes & 255, (codes >> 8) & 255
            table = order1 if k == 1 else np.broadcast_to(order0, (256, 256))
            seen = table[before, symbol].astype(float)
            total, kinds = table.sum(axis=1)[before].astype(float), (table > 0).sum(axis=1)[before].astype(float)
        # What the longer context has seen is excluded here.
        rest, new = total - longer_total, kinds - longer_kinds
        hit = open_ & (seen > 0)
        logp[hit] += np.log10(seen[hit] / (rest[hit] + new[hit]))
        escape = open_ & (seen == 0) & (new > 0)
        logp[escape] += np.log10(new[escape] / (rest[escape] + new[escape]))
        open_ &= seen == 0
        if k:
            longer_kinds = kinds
            longer_total = _excluded(codes, counts, order1, order0, k)
    logp[open_] -= np.log10(np.maximum(256 - (order0 > 0).sum(), 1))
    return logp


def _excluded(codes: np.ndarray, counts: np.ndarray, order1: np.ndarray, order0: np.ndarray, k: int) -> np.ndarray:
    """Per gram: counts, in its context of length k-1, of the symbols that its context of length k has seen."""
    if k == 1:
        return ((order1 > 0) * order0).sum(axis=1)[(codes >> 8) & 255].astype(float)
    keys, which = np.unique(codes & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
    c = np.bincount(which, counts, len(keys))
    if k == 2:
        shorter = order1[(keys >> 8) & 255, keys & 255].astype(float)
    else:
        below, at = np.unique(keys & ((1 << 8 * k) - 1), return_inverse=True)
        shorter = np.bincount(at, c, len(below))[at]
    contexts, of = np.unique(keys >> 8, return_inverse=True)
    return np.bincount(of, shorter * (c > 0), len(contexts))[of][which]


def _answers(pairs) -> object:
    """Slices: requests sorted by (kind, slice) in, one row (kind, slice, codes, values, n, kinds) out."""
    def finish(kind: int, slice_: int, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        values = log_probabilities(codes, counts, pairs.value) if kind == GRAM else counts.astype(float)
        return pa.RecordBatch.from_arrays([
            pa.array([kind], pa.int32()), pa.array([slice_], pa.int32()), pa.array([_squeeze(np.diff(codes, prepend=0))]), pa.array([_squeeze(values)]),
            pa.array([int(counts.sum())], pa.int64()), pa.array([int((counts > 0).sum())], pa.int64()),
        ], names=["kind", "slice", "codes", "values", "n", "kinds"])

    def merged(codes: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
        unique, which = np.unique(np.concatenate(codes), return_inverse=True)
        return unique, np.bincount(which, np.concatenate(counts), len(unique)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, codes, counts, size = None, [], [], 0
        for batch in batches:
            for kind, slice_, c, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (kind, slice_) != last:
                    if last:
                        yield finish(*last, *merged(codes, counts))
                    last, codes, counts, size = (kind, slice_), [], [], 0
                codes.append(np.cumsum(_expand(c)))
                counts.append(_expand(n))
                size += len(codes[-1])
                # Folded now and then: memory follows the slice, not the number of blocks.
                if size > 3_000_000 and len(codes) > 1:
                    folded = merged(codes, counts)
                    codes, counts, size = [folded[0]], [folded[1]], 0
        if last:
            yield finish(*last, *merged(codes, counts))

    return run


def _replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per (kind, slice): the slice's row comes first (no block), then the blocks' requests."""
    codes = values = np.zeros(0)
    for batch in batches:
        out = []
        for kind, slice_, block, c, v in zip(*(col.to_pylist() for col in batch.columns)):
            own = np.cumsum(_expand(c))
            if block is None:
                codes, values = own, _expand(v, np.float64)
                continue
            found = values[np.searchsorted(codes, own)]
            out.append((block, kind, slice_, _squeeze(found.astype(np.float32 if kind == GRAM else np.float64))))
        if out:
            b, k, s, x = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(k, pa.int32()), pa.array(s, pa.int32()), pa.array(x, pa.binary())], names=["block", "kind", "slice", "values"])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double"


def _score(n_train: int, kinds: int, train_docs: int):
    """Scores of one block from its texts and the replies of all slices."""
    floor = n_train + 0.1 * (kinds + 1)

    def values_of(kind: int, unique: np.ndarray, replies: list, dtype) -> np.ndarray:
        order, _, _ = by_slice(kind, unique)
        out = np.zeros(len(unique))
        if len(unique):
            out[order] = np.concatenate([_expand(v, dtype) for k, _, v in replies if k == kind])
        return out

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in ("ids", "held", "sizes", "body")}
        replies = sorted(zip(right.column("kind").to_pylist(), right.column("slice").to_pylist(), right.column("values").to_pylist()), key=lambda r: r[:2])
        own = Block(row["sizes"], row["body"])
        unique = different(own.codes)
        logp, ends = values_of(GRAM, unique, replies, np.float32), np.cumsum(own.sizes)
        score = np.add.reduceat(logp[placed(own.codes, unique)], ends - own.sizes)
        words = own.words()
        codes, n = word_codes(words, {}), np.array([len(w) for w in words], np.int64)
        known = different(codes)
        c = values_of(WORD, known, replies, np.float64)[np.searchsorted(known, codes)]
        doc = np.repeat(np.arange(len(n)), n)
        base = np.bincount(doc, np.log10((c + 0.1) / floor), len(n)) + np.log10((train_docs + 0.1) / floor)
        known = np.bincount(doc, c > 0, len(n)) + (train_docs > 0)
        return pa.table([
            pa.array(row["ids"], pa.int64()), pa.array(row["held"]), pa.array(n + 1), pa.array(known.astype(np.int64)), pa.array(own.sizes), pa.array(base), pa.array(score),
        ], names=[f.split()[0] for f in SCORES.split(", ")])

    return run


def ppm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes).

    The text scored is its words, A-Z in lower case, with single spaces between and an end. Documents
    whose crc32 of the id as text leaves 0 modulo 10 are held out, the others are learnt from; a null
    id counts as the empty text (held out), a null text as empty. ``base_score`` is the smoothed
    word-unigram log10 probability of the tokens. Rows that repeat an id are scored each; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    id_ = F.col(f"`{id_col}`")
    held = F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 10 == 0
    rows = docs.select(id_.cast("long").alias("id"), held.alias("held"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # Numbered as they are written: from here on a block has one number.
    blocks = staged(rows.mapInArrow(_blocks, BLOCK).withColumn("block", F.monotonically_increasing_id()), "text-blocks")
    requests = staged(blocks.select("block", "held", "sizes", "body").mapInArrow(_requests, REQUEST), "gram-requests")
    pairs = combined(requests.filter("piece IS NOT NULL"), np.int64, np.add, 1 << 16)
    asked = requests.filter("piece IS NULL")
    slices = staged(
        asked.select("kind", "slice", "codes", "counts").repartition("kind", "slice").sortWithinPartitions("kind", "slice")
        .mapInArrow(_answers(spark.sparkContext.broadcast(pairs)), "kind int, slice int, codes binary, values binary, n long, kinds long"), "trie-slices",
    )
    learned = blocks.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    words = slices.filter(F.col("kind") == WORD).agg(F.sum("n"), F.sum("kinds")).first()
    n_train, kinds = int(words[0] or 0) + learned, int(words[1] or 0) + (learned > 0)
    both = slices.select("kind", "slice", F.lit(None).cast("long").alias("block"), "codes", "values").union(
        asked.select("kind", "slice", "block", "codes", F.lit(None).cast("binary")),
    )
    replies = both.repartition("kind", "slice").sortWithinPartitions("kind", "slice", F.col("block").asc_nulls_first()).mapInArrow(_replies, "block long, kind int, slice int, values binary")
    scored = blocks.select("block", "ids", "held", "sizes", "body").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_score(n_train, kinds, learned), SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes")
