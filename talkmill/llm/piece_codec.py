"""SentencePiece ids by a prefix table, and texts from ids.

A list of pieces is what byte-pair merging makes of their joined text exactly when every piece
comes out of merging its own characters and no two neighbours merge across their border. So every
prefix of a text has one possible last piece: of the pieces that end there (an automaton finds
them), the one that stands the pair test with the last piece of the prefix before it. One pass
from left to right fills the table; ids are read off backwards.

Pieces carry the space mark only in front, so no piece crosses from a word to the next mark, nor
does one cross a character that no longer piece has, such as a line break. The table is filled
for each stretch between such places, and a stretch met before is looked up.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from itertools import groupby
from types import ModuleType

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkmill.llm.common import by_value

by_value(__name__)

MARK = "▁"
#: Words and piece pairs a Python worker remembers before it forgets all of them; longer words are not remembered.
MEMORY_WORDS, MEMORY_PAIRS, MEMORY_LENGTH = 600_000, 1_000_000, 64
#: UTF-8 bytes of texts that leave a task as one batch.
BATCH_BYTES = 4 << 20

#: Texts that a model must encode alike after the plain rule (mark in front, spaces to marks).
_PROBES = ("a  b", " a", "a ", "\ta\n", "ﬁ①ｱ", "é", "À", "日 本", "​ ", "")


class PieceTable:
    """What the executors need of a model: pieces by best score first, byte ids, the end id."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int], end: int):
        self.pieces, self.byte_ids, self.end = pieces, byte_ids, end
        for piece, _, _ in pieces:
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"a piece with the space mark inside can't be encoded by words: {piece!r}")


def piece_table(model_path: str) -> PieceTable:
    """Reads a BPE model with byte fallback on the driver; models that rewrite texts are refused."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    size = model.get_piece_size()
    special = {i for i in range(size) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
    pieces = [(model.id_to_piece(i), model.get_score(i), i) for i in range(size) if i not in special]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(model.is_byte(i) for i in byte_ids):
        raise ValueError("the model has no byte fallback")
    table = PieceTable(pieces, byte_ids, model.eos_id())
    codec = PieceCodec(table)
    for text in _PROBES:
        if codec.encode(text).tolist() != model.encode(text):
            raise ValueError(f"the model changes texts before it encodes them, or is no BPE model: {text!r}")
    return table


class PieceCodec:
    """Encodes and decodes with one vocabulary; keeps words and pair tests it has met."""

    def __init__(self, table: PieceTable):
        joined = {c for piece, _, _ in table.pieces if len(piece) > 1 for c in piece} - {MARK}
        inside = "".join(re.escape(c) for c in sorted(joined))
        self.stretches = re.compile((f"{MARK}*[{inside}]+|{MARK}+|[^{MARK}{inside}]" if joined else f"{MARK}+|[^{MARK}]"), re.DOTALL)
        order = {s: r for r, s in enumerate(sorted({s for _, s, _ in table.pieces}, reverse=True))}
        self.ranks = {piece: order[score] for piece, score, _ in table.pieces}
        self.byte_ids, self.end = table.byte_ids, table.end
        self.surface: dict[int, bytes] = {i: piece.replace(MARK, " ").encode() for piece, _, i in table.pieces}
        self.marked = {i for piece, _, i in table.pieces if piece.startswith(MARK)}
        self.surface |= {i: bytes([b]) for b, i in enumerate(table.byte_ids)}
        # Characters that occur in pieces without being one are steps on the way, spelled in bytes at the end.
        ids = {piece: (i,) for piece, _, i in table.pieces}
        steps = {c for piece in ids for c in piece if c not in ids}
        ids |= {c: self._fallback(c) for c in steps}
        self.strings, self.ids, self.lengths = [], [], []
        self.automaton = ahocorasick.Automaton()
        for string, own in ids.items():
            if len(string) == 1 or self._merges_to_itself(string):
                self.automaton.add_word(string, (len(string), len(self.strings)))
                self.strings.append(string)
                self.ids.append(own)
                self.lengths.append(len(string))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def _fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass"))

    def _next_merge(self, ends: list[int], text: str) -> int:
        """Place of the adjacent pair that merges next (best rank, then leftmost), or -1."""
        best, at, start = None, -1, 0
        for k in range(len(ends) - 1):
            rank = self.ranks.get(text[start:ends[k + 1]])
            if rank is not None and (best is None or rank < best):
                best, at = rank, k
            start = ends[k]
        return at

    def _merges_to_itself(self, text: str) -> bool:
        ends = list(range(1, len(text) + 1))
        while len(ends) > 1:
            at = self._next_merge(ends, text)
            if at < 0:
                return False
            del ends[at]
        return True

    def stands(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces gives these two pieces again.

        Both come out of their own characters, so they do unless a pair across the border merges.
        """
        border = len(self.strings[left])
        text = self.strings[left] + self.strings[right]
        ends = list(range(1, len(text) + 1))
        while (at := self._next_merge(ends, text)) >= 0:
            if ends[at] == border:
                return False
            del ends[at]
        return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of one stretch."""
        pairs, kinds = self.pairs, len(self.strings)
        if len(pairs) >= MEMORY_PAIRS:
            pairs.clear()
        # Last piece of every prefix; -1 at the start and after a character that no piece has.
        last = [-1] * (len(word) + 1)
        for stop, (length, piece) in self.automaton.iter(word):
            stop += 1
            if last[stop] >= 0:
                continue
            before = last[stop - length]
            if before >= 0:
                key = before * kinds + piece
                known = pairs.get(key)
                if known is None:
                    known = pairs[key] = self.stands(before, piece)
                if not known:
                    continue
            last[stop] = piece
        out, at = [], len(word)
        while at:
            piece = last[at]
            if piece >= 0:
                out.extend(self.ids[piece][::-1])
                at -= self.lengths[piece]
            else:
                out.extend(self._fallback(word[at - 1])[::-1])
                at -= 1
        out.reverse()
        return out

    def _looked_up(self, word: str) -> bytes:
        known = self.words.get(word)
        if known is None:
            known = array("i", self.encode_word(word)).tobytes()
            if len(word) <= MEMORY_LENGTH:
                if len(self.words) >= MEMORY_WORDS:
                    self.words.clear()
                self.words[word] = known
        return known

    def encode(self, text: str, end: bool = False) -> np.ndarray:
        """Ids of a text, with the end id if wanted."""
        raw = b"".join([self._looked_up(w) for w in self.stretches.findall(MARK + text.replace(" ", MARK))]) if text else b""
        if end:
            raw += array("i", [self.end]).tobytes()
        return np.frombuffer(raw, np.int32)

    def decode(self, ids: list[int]) -> str:
        """Text of any ids; control ids have none, and the mark that encoding puts in front goes."""
        surface = self.surface
        shown = ids[:-1] if ids and ids[-1] == self.end else ids
        try:
            runs = [b"".join([surface[i] for i in shown])]
        except KeyError:  # bytes on both sides of a control id make no character
            runs = [b"".join([surface[i] for i in run]) for known, run in groupby(ids, surface.__contains__) if known]
        first = next((i for i in ids if i in surface), None)
        if first in self.marked:
            runs[0] = runs[0][1:]
        return "".join(map(_lenient, runs))


def _lenient(raw: bytes) -> str:
    """UTF-8 text; each byte that is part of no character becomes the replacement character."""
    parts, at = [], 0
    while True:
        try:
            parts.append(raw[at:].decode())
            return "".join(parts)
        except UnicodeDecodeError as bad:
            parts.append(raw[at:at + bad.start].decode() + "�")
            at += bad.start + 1


def _codec(name: str, shared) -> PieceCodec:
    """A codec that a Python worker keeps between tasks."""
    kept = sys.modules.setdefault("_talkmill_codecs", ModuleType("_talkmill_codecs")).__dict__
    if name not in kept:
        kept[name] = PieceCodec(shared.value)
    return kept[name]


def _arrow(ids: list, docs: list[np.ndarray], decoded: list[str]) -> pa.RecordBatch:
    offsets = np.zeros(len(docs) + 1, np.int32)
    np.cumsum([len(d) for d in docs], out=offsets[1:])
    values = pa.array(np.concatenate(docs) if docs else np.zeros(0, np.int32), pa.int32())
    lists = pa.ListArray.from_arrays(pa.array(offsets), values)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row (doc_id, ids, decoded): the ids of the whole text with an end id, and their text.

    Null counts as the empty text, which has the end id alone. Ids may be null or repeat: every
    row is encoded by itself; an empty table gives no rows. Only the vocabulary goes to the
    executors, tens of thousands of pieces whatever the corpus; there is no shuffle.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(piece_table(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path, shared)
        for batch in batches:
            ids, arrays, texts, size = [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = codec.encode(text or "", end=True)
                surface = codec.decode(own.tolist())
                ids.append(doc_id)
                arrays.append(own)
                texts.append(surface)
                size += len(surface) + 4 * len(own)
                if size >= BATCH_BYTES:
                    yield _arrow(ids, arrays, texts)
                    ids, arrays, texts, size = [], [], [], 0
            if ids:
                yield _arrow(ids, arrays, texts)

    rows = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decoded(rows: DataFrame, model_path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns and the text of a column of id arrays; null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(piece_table(model_path))

    @F.pandas_udf("string")
    def text_of(ids):
        codec = _codec(model_path, shared)
        return ids.map(lambda own: None if own is None else codec.decode(list(own)))

    return rows.withColumn(into, text_of(F.col(f"`{ids_col}`")))


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded rows."""
    def sha(text: Column) -> Column:
        return F.sha2(F.encode(text, "UTF-8"), 256)

    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"),
    )
