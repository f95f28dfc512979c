"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its lower-cased words. Lines with equal sets are grouped by a 128-bit digest. For
the rest the words of a line are ordered by rarity and the first ones (the prefix) are posted: two
sets at the threshold share a word of both prefixes. Postings of one word are compared under the length
filter, the positional filter and a bound from 128-bit parity bitmaps (differing bits never exceed
differing words); survivors are verified word by word. A line goes when an earlier line matches it,
whether or not that one stays.

Rarity is counted over the whole corpus in a table of hash buckets, so its size is fixed; any
order of words gives the same result. In a long posting list each line keeps the candidates found
first; should all that a line has fail the verification, it is compared with the whole of those lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from talkmill.llm.common import by_value, combined, free_name, pieces_of, staged

by_value(__name__)

#: Similarity at least UP / OF.
UP, OF = 4, 5
#: Buckets of the rarity table (a power of two) and bits of the table of wanted lines.
BUCKETS, WANTED_BITS = 1 << 18, 1 << 23
#: Sets smaller than this match equal sets only, which the digest finds.
SMALLEST = 4
#: Posting lists up to this length give all candidates; in longer ones a line that has so many convincing
#: candidates gets no more. Convincing: random sets would hardly stay below so many differing bits.
SHORT, ENOUGH, CONVINCING = 16, 3, 32
#: Postings of a slot, about; slots of a task, about; postings that are packed together.
SLOT, SLOTS, PACKED = 64_000, 4, 1 << 18
#: Characters handled in one go; a longer text is handled alone.
CHUNK = 1_500_000
MASK = (1 << 63) - 1


def key_of(id_: Column, text: Column) -> Column:
    """Key and order of a document: its id; without one a negative number made from its text."""
    return F.coalesce(id_.cast("long"), -1 - F.shiftrightunsigned(F.xxhash64(text), 2))


#: Words longer than this are hashed one by one, shorter ones eight bytes at a time for all words.
LONG_WORD = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Which bits of eight bytes belong to a word with so many bytes left.
_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """63-bit hashes of the words at some places of a text as bytes."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    h = _mixed((eight[starts] & _LEFT[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * _STEP)
    for at in range(8, LONG_WORD, 8):
        more = np.flatnonzero(lengths > at)
        if not len(more):
            break
        starts, lengths, whole = starts[more], lengths[more], more if at == 8 else whole[more]
        h[whole] = _mixed(h[whole] * _STEP + (eight[starts + at] & _LEFT[np.minimum(lengths - at, 8)]))
    else:
        for k in np.flatnonzero(lengths > LONG_WORD).tolist():
            h[whole[k]] = xxhash.xxh64_intdigest(raw[starts[k]:starts[k] + lengths[k]].tobytes())
    return (h & np.uint64(MASK)).astype(np.int64)


def order_by(line: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    """Order by line, then by a key of so many bits, then by place: one sort of packed numbers where they fit."""
    most = int(line.max(initial=0)).bit_length()
    low = len(line).bit_length()
    if most + bits + low > 63:
        return np.lexsort((key, line))
    return np.sort((line << (bits + low)) | (key << low) | np.arange(len(line))) & ((1 << low) - 1)


def order_by_hash(line: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Order by line, then by hash: by its leading bits, as long as no different hashes of a line share them."""
    bits = min(43, 63 - int(line.max(initial=0)).bit_length() - len(line).bit_length())
    if bits > 15:
        order = order_by(line, hashes >> (63 - bits), bits)
        of, own = line[order], hashes[order]
        if not ((of[1:] == of[:-1]) & (own[1:] != own[:-1]) & (own[1:] >> (63 - bits) == own[:-1] >> (63 - bits))).any():
            return order
    return np.lexsort((hashes, line))


class Lines:
    """Distinct words of the non-blank lines of some documents, as flat arrays sorted by line."""

    def __init__(self, keys: list[int], texts: list[str | None], chosen: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        """``chosen`` tells which lines, by key and number, are cut into words; the others are left out."""
        bodies = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        raw = np.frombuffer(b"\n".join(bodies) + b"\n", np.uint8)
        breaks = np.flatnonzero(raw == 10)
        ends = np.cumsum([len(b) + 1 for b in bodies]) - 1
        first_line = np.concatenate([[0], np.searchsorted(breaks, ends)[:-1] + 1]) if len(bodies) else np.zeros(0, np.int64)
        keys, source = np.array(keys, np.int64), np.arange(len(breaks))
        if chosen:
            of = np.searchsorted(first_line, source, "right") - 1
            hit = chosen(keys[of], source - first_line[of])
            raw = raw[np.repeat(hit, np.diff(breaks, prepend=-1))]
            breaks, source = np.flatnonzero(raw == 10), source[hit]
        # Blanks are 9 to 13 and 32. A word starts at a letter after a blank; the buffer ends with a blank.
        blank = np.concatenate([[True], (raw - np.uint8(9) < 5) | (raw == 32)])
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        starts, stops = edge[::2], edge[1::2]
        # The line of a word: words before each line break, spread over the words.
        per_line = np.diff(np.searchsorted(starts, breaks), prepend=0)
        present = np.flatnonzero(per_line)
        line = np.repeat(np.arange(len(present)), per_line[present])
        doc = np.searchsorted(first_line, source[present], "right") - 1
        self.doc, self.number = keys[doc], source[present] - first_line[doc]
        hashes = word_hashes(raw, starts, stops - starts)
        hashes = hashes[order_by_hash(line, hashes)]
        fresh = np.ones(len(line), bool)
        fresh[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
        self.line, self.hash = line[fresh], hashes[fresh]
        self.n = np.bincount(self.line, minlength=len(present))
        self.start = np.cumsum(self.n) - self.n

    def digests(self) -> np.ndarray:
        """Two longs per line from its sorted distinct words."""
        raw, out = self.hash.tobytes(), bytearray()
        for s, n in zip((self.start * 8).tolist(), (self.n * 8).tolist()):
            out += xxhash.xxh3_128_digest(raw[s:s + n])
        return np.frombuffer(bytes(out), np.int64).reshape(-1, 2)

    def bitmaps(self) -> np.ndarray:
        """Parity bitmap of 128 bits per line: every distinct word flips one bit."""
        bit = (self.hash >> 20) & 127
        flips = np.bincount(self.line * 128 + bit, minlength=len(self.n) * 128).reshape(-1, 128) & 1
        return np.packbits(flips.astype(np.uint8), axis=1).view(np.int64)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    start, size = 0, 0
    for stop, text in enumerate(texts, 1):
        size += len(text or "")
        if size >= CHUNK or stop == len(texts):
            yield keys[start:stop], texts[start:stop]
            start, size = stop, 0


def _over_lines(work: Callable[[Lines], Iterator[pa.RecordBatch]], last: Callable[[], Iterator[pa.RecordBatch]] | None = None, chosen=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in _chunks(batch):
                lines = Lines(keys, texts, chosen)
                if len(lines.n):
                    yield from work(lines)
        if last:
            yield from last()
    return run


LINE_COLUMNS = ["doc", "line", "d1", "d2", "n", "piece", "content"]
LINE_TYPES = {"doc": pa.int64(), "line": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "n": pa.int64(), "piece": pa.int32(), "content": pa.binary()}


def _all_lines(docs: DataFrame) -> DataFrame:
    """Every non-blank line with its digest, and the words per rarity bucket of each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)

        def work(lines: Lines) -> Iterator[pa.RecordBatch]:
            seen[:] += np.bincount(lines.hash & (BUCKETS - 1), minlength=BUCKETS)
            d = lines.digests()
            arrays = {"doc": lines.doc, "line": lines.number, "d1": d[:, 0], "d2": d[:, 1], "n": lines.n.astype(np.int64)}
            yield pa.RecordBatch.from_arrays(
                [pa.array(arrays[c]) if c in arrays else pa.nulls(len(lines.n), LINE_TYPES[c]) for c in LINE_COLUMNS], names=LINE_COLUMNS,
            )

        yield from _over_lines(work, lambda: pieces_of(seen, LINE_COLUMNS, LINE_TYPES))(batches)

    return docs.mapInArrow(run, "doc long, line long, d1 long, d2 long, n long, piece int, content binary")


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Words of a set of n of which a set at the threshold must share one."""
    return n - -(-n * UP // OF) + 1


def _postings(docs: DataFrame, rarity, slots: int, only=None) -> DataFrame:
    """(slot, content): the prefix words of lines as rows of (word, doc, line, shape, b1, b2, d1); shape holds set size and position.

    Postings travel in packets: those of some documents that fall into one of ``slots`` slots of words
    are one row. Of equal lines of one task the earliest is posted. ``only`` is a table of wanted words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, known, held = rarity.value, {}, []

        def packed() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held) if held else np.zeros((0, 7), np.int64)
            held.clear()
            for start in range(0, len(rows), PACKED):
                yield _packets(rows[start:start + PACKED], slots)

        def work(lines: Lines) -> Iterator[pa.RecordBatch]:
            d = lines.digests()
            once = np.zeros(len(lines.n), bool)
            # Input order isn't always key order: an earlier line replaces what was posted for its set.
            for i, (a, b, doc, number) in enumerate(zip(d[:, 0].tolist(), d[:, 1].tolist(), lines.doc.tolist(), lines.number.tolist())):
                if known.get((a, b), (MASK, 0)) > (doc, number):
                    known[(a, b)] = (doc, number)
                    once[i] = True
            if len(known) > 500_000:
                known.clear()
            once &= lines.n >= SMALLEST
            posted = once[lines.line]
            line, word = lines.line[posted], lines.hash[posted]
            # By rarity, then by hash: the words of a line are in the order of their hashes.
            word = word[order_by(line, rank[word & (BUCKETS - 1)].astype(np.int64), 8)]
            n = lines.n[once]
            at = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
            keep = at < np.repeat(prefix_length(n), n)
            line, at, word = line[keep], at[keep], word[keep]
            if only is not None:
                hit = wanted(only.value, word, word * 0)
                line, at, word = line[hit], at[hit], word[hit]
            if len(line):
                bits = lines.bitmaps()
                held.append(np.stack([word, lines.doc[line], lines.number[line], (lines.n[line] << 24) | at, bits[line, 0], bits[line, 1], d[line, 0]], axis=1))
                if sum(map(len, held)) >= PACKED:
                    yield from packed()

        yield from _over_lines(work, packed)(batches)

    return docs.mapInArrow(run, "slot long, content binary")


def _packets(rows: np.ndarray, slots: int) -> pa.RecordBatch:
    slot = rows[:, 0] % slots
    order = np.argsort(slot, kind="stable")
    slot, rows = slot[order], rows[order]
    starts = np.flatnonzero(np.diff(slot, prepend=-1))
    offsets = (np.append(starts, len(rows)) * rows.itemsize * rows.shape[1]).astype(np.int32)
    content = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])
    return pa.RecordBatch.from_arrays([pa.array(slot[starts]), content], names=["slot", "content"])


def bits_differ(bits: tuple, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Differing bits of two bitmaps. Counted unsigned: of a negative number numpy counts its absolute value."""
    return sum(np.bitwise_count((b[y] ^ b[x]).view(np.uint64)).astype(np.int64) for b in bits)


def _candidates(every: bool, only=None) -> Callable:
    """Pairs (doc, line, of_doc, of_line, word) from packets of postings sorted by slot.

    Neighbours at distance 1, 2, ... are compared, all lists of a batch at once; sizes ascend, so a row
    leaves the comparison when its partner has become too small. In lists longer than SHORT a line that
    has ENOUGH candidates gets no more; ``word`` then names the list. With ``every`` the lines in the table
    ``only`` get all.
    """
    def solve(rows: np.ndarray, place: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, at, bits = rows[:, 3] >> 24, rows[:, 3] & 0xFFFFFF, (rows[:, 4], rows[:, 5])
        done = ~wanted(only.value, rows[:, 1], rows[:, 2]) if every else np.zeros(len(rows), bool)
        long, active, d = size > SHORT, np.flatnonzero(place > 0), 0
        found = np.zeros(len(rows), np.int64)
        while len(active):
            d += 1
            active = active[place[active] >= d]
            active = active[OF * n[active - d] >= UP * n[active]]
            a, b = active, active - d
            # The later line of a pair is the one that may go.
            swap = (rows[b, 1] > rows[a, 1]) | ((rows[b, 1] == rows[a, 1]) & (rows[b, 2] > rows[a, 2]))
            y, x = np.where(swap, b, a), np.where(swap, a, b)
            open_ = ~done[y]
            y, x = y[open_], x[open_]
            total = n[y] + n[x]
            need = -(-UP * total // (UP + OF))
            ok = np.minimum(n[y] - at[y], n[x] - at[x]) >= need
            y, x, total, need = y[ok], x[ok], total[ok], need[ok]
            ok = bits_differ(bits, y, x) <= total - 2 * need
            y, x = y[ok], x[ok]
            # A line posted by two tasks is no partner of its own.
            other = (rows[y, 1] != rows[x, 1]) | (rows[y, 2] != rows[x, 2])
            y, x = y[other], x[other]
            if len(y):
                if not every:
                    sure = y[long[y] & (n[y] + n[x] <= CONVINCING * (OF + UP) // (OF - UP))]
                    np.add.at(found, sure, 1)
                    done[sure] = found[sure] >= ENOUGH
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, (rows[y, 1], rows[y, 2], rows[x, 1], rows[x, 2])), pa.array(rows[y, 0], mask=~(long[y] & (not every)))],
                    names=["doc", "line", "of_doc", "of_line", "word"],
                )

    def compared(packets: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(b"".join(packets), np.int64).reshape(-1, 7)
        rows = rows[np.argsort(rows[:, 0])]
        edge = np.diff(rows[:, 0], prepend=-1, append=-1) != 0
        # Lists of one posting have no partner.
        rows = rows[~(edge[1:] & edge[:-1])]
        rows = rows[order_by_hash(np.cumsum(np.diff(rows[:, 0], prepend=-1) != 0), rows[:, 6] & MASK)]
        # Of equal lines of several tasks the first stays: no line that an equal one precedes looks for partners.
        again = (np.diff(rows[:, 0], prepend=-1) == 0) & (np.diff(rows[:, 6] & MASK, prepend=-1) == 0)
        equal = again | np.append(again[1:], False)[:len(again)]
        twins = rows[equal]
        rows[equal] = twins[np.lexsort((twins[:, 2], twins[:, 1], np.cumsum(~again)[equal]))]
        rows = rows[~again]
        starts = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
        sizes = np.diff(np.append(starts, len(rows)))
        rows, sizes = rows[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
        if len(rows):
            starts, size = np.cumsum(sizes) - sizes, np.repeat(sizes, sizes)
            rows = rows[np.argsort((np.repeat(np.arange(len(sizes)), sizes) << 32) | (rows[:, 3] >> 24))]
            yield from solve(rows, np.arange(len(rows)) - np.repeat(starts, sizes), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            for slot, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and slot != of:
                    yield from compared(held)
                    held = []
                held.append(content)
                of = slot
        if held:
            yield from compared(held)

    return run


def _slot(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    mixed = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(20)).astype(np.int64) % WANTED_BITS


def wanted(bits: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Whether lines may be in a table of wanted lines; never false for one that is."""
    slot = _slot(doc, line)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def _wanted_table(lines: DataFrame) -> np.ndarray:
    """Bit table of (doc, line) rows; its size is fixed, a full table only filters less."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(WANTED_BITS >> 3, np.uint8)
        for batch in batches:
            slot = _slot(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        yield from pieces_of(bits, ["piece", "content"], {})

    return combined(lines.select("doc", "line").mapInArrow(run, "piece int, content binary"), np.uint8, np.bitwise_or, WANTED_BITS >> 3)


def _words_of(docs: DataFrame, bits, doc_bits) -> DataFrame:
    """(doc, line, words): the distinct words of lines that may be wanted; other documents aren't parsed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value

        def documents() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc = batch.column(0).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(wanted(doc_bits.value, doc, doc * 0)))

        def work(lines: Lines) -> Iterator[pa.RecordBatch]:
            words = pa.ListArray.from_arrays(pa.array(np.append(lines.start, len(lines.hash)).astype(np.int32)), pa.array(lines.hash))
            yield pa.RecordBatch.from_arrays([pa.array(lines.doc), pa.array(lines.number), words], names=["doc", "line", "words"])

        yield from _over_lines(work, chosen=lambda doc, line: wanted(table, doc, line))(documents())

    return docs.mapInArrow(run, "doc long, line long, words array<bigint>")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with ``match``: does the Jaccard similarity of the word sets reach the threshold?"""
    spark = docs.sparkSession
    ends = pairs.select("doc", "line").union(pairs.select("of_doc", "of_line")).distinct()
    ends = staged(ends, "line-ends")
    tables = [_wanted_table(ends), _wanted_table(ends.select("doc", F.lit(0).cast("long").alias("line")))]
    words = staged(_words_of(docs, *map(spark.sparkContext.broadcast, tables)).dropDuplicates(["doc", "line"]), "line-words")
    left = words.select("doc", "line", F.col("words").alias("_y"))
    right = words.select(F.col("doc").alias("of_doc"), F.col("line").alias("of_line"), F.col("words").alias("_x"))
    joined = pairs.join(left, ["doc", "line"]).join(right, ["of_doc", "of_line"])
    shared = F.size(F.array_intersect("_y", "_x"))
    union = F.size("_y") + F.size("_x") - shared
    return joined.select(*pairs.columns, (OF * shared >= UP * union).alias("match"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, line, of_doc, of_line): every line that an earlier line matches, and one such line.

    Lines are numbered from 0 by their ``\\n``; blank lines match nothing. Lines are in the order of the
    document key, then of their number. See ``key_of`` for documents without an id.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(key_of(F.col(f"`{id_col}`"), text).alias("doc"), text.alias("text"))
    parsed = staged(_all_lines(rows), "lines")
    rarity = combined(parsed.filter("piece IS NOT NULL"), np.int64, np.add, BUCKETS)
    lines = parsed.filter("piece IS NULL").select("doc", "line", "d1", "d2")
    first = lines.groupBy("d1", "d2").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    equal = staged(
        lines.join(first, ["d1", "d2"]).filter(F.struct("doc", "line") > F.col("first"))
        .select("doc", "line", F.col("first.doc").alias("of_doc"), F.col("first.line").alias("of_line")), "equal-lines",
    )
    # A fifth of the words of a line is posted, and one more; slots grow in number, not in size.
    slots = max(32, int(rarity.sum()) // (SLOT * OF // (OF - UP)) + 1)
    ordered = lambda p: p.repartition(slots // SLOTS, "slot").sortWithinPartitions("slot")
    # Classes of frequency, an eighth of a power of two wide.
    classes = spark.sparkContext.broadcast(np.minimum(8 * np.log2(rarity + 1), 255).astype(np.uint8))
    postings = _postings(rows, classes, slots)
    kind = "doc long, line long, of_doc long, of_line long, word long"
    found = ordered(postings).mapInArrow(_candidates(False), kind)
    open_pairs = staged(found.groupBy("doc", "line", "of_doc", "of_line").agg(F.collect_set("word").alias("lists")), "line-pairs")
    judged = staged(_verified(rows, open_pairs), "line-verdicts")
    near = judged.filter("match").groupBy("doc", "line").agg(F.min(F.struct("of_doc", "of_line")).alias("of")).select("doc", "line", "of.*")
    verdict = judged.groupBy("doc", "line").agg(F.max("match").alias("match"), F.count_if(F.size("lists") > 0).alias("cut")).filter("NOT match AND cut > 0")
    unsure = staged(verdict.select("doc", "line"), "unsure-lines")
    result = equal.union(near)
    if not unsure.isEmpty():
        # All candidates failed, in long lists too: these lines are compared with the whole of those lists.
        only = spark.sparkContext.broadcast(_wanted_table(unsure))
        cut = judged.join(unsure, ["doc", "line"], "left_semi").select(F.explode("lists").alias("doc")).distinct().withColumn("line", F.lit(0).cast("long"))
        again = _postings(rows, classes, slots, spark.sparkContext.broadcast(_wanted_table(cut)))
        rest = ordered(again).mapInArrow(_candidates(True, only), kind).join(unsure, ["doc", "line"], "left_semi")
        late = _verified(rows, staged(rest.select("doc", "line", "of_doc", "of_line").distinct(), "line-pairs")).filter("match")
        result = result.union(late.groupBy("doc", "line").agg(F.min(F.struct("of_doc", "of_line")).alias("of")).select("doc", "line", "of.*"))
    return staged(result, "repeated-lines")


def _told_apart(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """The documents and the column that names them: the id, or, where ids come with different texts, a number.

    The numbers keep the order of the ids; texts of one id are ordered by hash. Rows equal in id and
    text stay one document, rows without an id are told apart by their texts already.
    """
    id_, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    different = docs.select(id_.alias("_of"), F.xxhash64(text).alias("_text")).where("_of IS NOT NULL").distinct()
    most, widest = different.groupBy("_of").agg(F.count("*").alias("n")).agg(F.max("n"), F.max(F.abs("_of"))).first()
    if (most or 1) == 1:
        return docs, id_col
    bits = (most - 1).bit_length()
    if widest >> (61 - bits):
        raise ValueError("ids are too large to number the texts that share one")
    number = F.row_number().over(Window.partitionBy("_of").orderBy("_text")) - 1
    key, hash_, of, own = (free_name(docs.columns, c) for c in ("number", "hash", "of", "own"))
    numbers = different.select(F.col("_of").alias(of), F.col("_text").alias(own), (F.shiftleft(F.col("_of"), bits) + number).alias(key))
    named = docs.withColumn(hash_, F.xxhash64(text)).join(numbers, (id_ == F.col(of)) & (F.col(hash_) == F.col(own)), "left")
    return named.select(*[F.col(f"`{c}`") for c in docs.columns], key), key


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_lines, n_removed, removed): which lines go, by number.

    Null and blank texts have no lines; rows equal in id and text get the same answer, rows that
    share an id but not the text are documents of their own; an empty table gives no rows.
    """
    docs, name = _told_apart(docs, id_col, text_col)
    gone = _by_document(repeated_lines(docs, name, text_col))
    text = F.col(f"`{text_col}`").cast("string")
    n_lines = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), key_of(F.col(f"`{name}`"), text).alias("_key"), n_lines.alias("n_lines"))
    return rows.join(gone, F.col("_key") == F.col("_doc"), "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"),
    )


def _by_document(lines: DataFrame, key: str = "_doc", removed: str = "removed") -> DataFrame:
    return lines.groupBy(F.col("doc").alias(key)).agg(F.sort_array(F.collect_set("line")).alias(removed))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = True) -> DataFrame:
    """Documents, all columns, without lines that an earlier line matches.

    A document that loses all its words goes too, unless ``drop_emptied`` is off; documents without
    words and null texts are left as they are. Rows that share an id but not the text are documents
    of their own; rows equal in both lose the same lines. An empty table stays empty.
    """
    columns, schema = docs.columns, docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string")).schema
    docs, name = _told_apart(docs, id_col, text_col)
    key, doc, lost = (free_name(docs.columns, c) for c in ("key", "doc", "removed"))
    gone = _by_document(repeated_lines(docs, name, text_col), doc, lost)
    text = F.col(f"`{text_col}`").cast("string")
    joined = docs.withColumn(key, key_of(F.col(f"`{name}`"), text)).join(gone, F.col(key) == F.col(doc), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, removed = batch.schema.get_field_index(text_col), batch.column(batch.num_columns - 1).to_pylist()
            texts = batch.column(at).to_pylist()
            for i, lines in enumerate(removed):
                if lines:
                    drop = set(lines)
                    texts[i] = "\n".join(x for n, x in enumerate(texts[i].split("\n")) if n not in drop)
            columns = [pa.array(texts, pa.string()) if c == at else batch.column(c) for c in range(batch.num_columns - 1)]
            out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])
            yield out.filter(pa.array([not (drop_emptied and r and not t.strip(" \t\n\x0b\x0c\r")) for r, t in zip(removed, texts)], pa.bool_()))

    return joined.select(*[F.col(f"`{c}`") for c in columns], lost).mapInArrow(cut, schema)
