"""Token counts by byte-pair merging on a heap and a linked list.

The text is a list of symbols (one per character). The adjacent pair with the best rank is popped
from a heap and merged, its neighbours form new pairs, until no pair is in the vocabulary. The
count is the initial number of symbols minus the merges; no identifiers are made. Characters the
vocabulary lacks fall back to their UTF-8 bytes and count as that many symbols.

Pieces carry the space mark only in front, so merges never cross from a word to the next mark:
a text is the sum of its marked words, and a word met before is looked up.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from types import ModuleType

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from talkmill.llm.common import by_value

by_value(__name__)

MARK = "▁"
_MARKED_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words a Python worker remembers before it forgets all of them.
MEMORY_WORDS = 400_000
#: Words longer than this are counted anew each time.
MEMORY_LENGTH = 64

COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


class PieceMerger:
    """Counts tokens of one piece vocabulary. ``ranks``: piece -> rank, lowest first."""

    def __init__(self, ranks: dict[str, int], dummy_prefix: bool = True):
        for piece in ranks:
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"a piece with the space mark inside can't be counted by words: {piece!r}")
        self.ranks, self.dummy_prefix = ranks, dummy_prefix
        self.memory: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        memory, total = self.memory, 0
        for word in _MARKED_WORD.findall(marked):
            n = memory.get(word)
            if n is None:
                n = self.count_word(word)
                if len(word) <= MEMORY_LENGTH:
                    if len(memory) >= MEMORY_WORDS:
                        memory.clear()
                    memory[word] = n
            total += n
        return total

    def count_word(self, word: str) -> int:
        """Initial symbols minus merges."""
        ranks = self.ranks
        size = len(word)
        # Symbol i spans [i, end[i]) while it lives; before/after link the living ones.
        end, before, after = list(range(1, size + 1)), list(range(-1, size - 1)), list(range(1, size + 1))
        alive = bytearray(b"\x01") * size
        heap = []
        for i in range(size - 1):
            rank = ranks.get(word[i:i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapify(heap)
        merges = 0
        while heap:
            _, left, stop = heappop(heap)
            if not alive[left] or end[left] >= stop:
                continue
            right = after[left]
            # A pair is stale when one side has been merged since it was pushed.
            if right >= size or end[right] != stop:
                continue
            merges += 1
            alive[right] = 0
            end[left] = stop
            after[left] = following = after[right]
            if following < size:
                before[following] = left
                rank = ranks.get(word[left:end[following]])
                if rank is not None:
                    heappush(heap, (rank, left, end[following]))
            previous = before[left]
            if previous >= 0:
                rank = ranks.get(word[previous:stop])
                if rank is not None:
                    heappush(heap, (rank, previous, stop))
        symbols = size
        for c in word:
            if c not in ranks:
                symbols += len(c.encode("utf-8", "surrogatepass")) - 1
        return symbols - merges


def piece_ranks(model_path: str) -> dict[str, int]:
    """Pieces that text can become, by rank (best score first); read on the driver."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [
        i for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    scores = {i: model.get_score(i) for i in ids}
    order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
    return {model.id_to_piece(i): order[scores[i]] for i in ids}


def _merger(name: str, shared) -> PieceMerger:
    """A merger that a Python worker keeps, so words are remembered between tasks."""
    kept = sys.modules.setdefault("_talkmill_mergers", ModuleType("_talkmill_mergers")).__dict__
    if name not in kept:
        kept[name] = PieceMerger(shared.value)
    return kept[name]


def token_counts(
    docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document (doc_id, n_bytes, n_tokens, over_limit); null counts as the empty text.

    The vocabulary is the only thing sent to the executors: tens of thousands of pieces whatever
    the corpus. Rows are counted where they are read, without a shuffle.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(piece_ranks(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(model_path, shared)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                pa.array([merger.count(t or "") for t in texts], pa.int64()),
            ], schema=COUNTS)

    rows = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
