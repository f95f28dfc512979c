"""Quality rules by tokeniser fertility.

Public vocabularies measure every text: characters per token (two vocabularies), the share of
tokens that fell back to bytes, and the entropy of the token distribution. Texts of one language
(or, without a language, of one script) and of similar length agree closely in these, so the
corpus itself gives the bands: median plus or minus several interquartile ranges, and never
narrower than a fixed floor. What lies outside a band is rejected, besides the plain rules on
length and repetition. No text is judged by texts of another language: the band of a length class
leans on the band of its language, which has wide floors, the more the fewer texts it has.

Bands come from histograms of all texts that pass the plain rules; texts with equal measures
(copies) count once, so a large group of copies does not narrow a band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from talkmill.llm.common import by_value, same, staged

by_value(__name__)

BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Words a task remembers before it forgets all; three word numbers fit into one long.
MEMORY_WORDS = 300_000
#: Words measured in one go.
CHUNK_WORDS = 200_000
#: Scripts by code points.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F),
    ("devanagari", 0x900, 0x97F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7A3),
]

#: Measure -> (steps per unit in the histogram, least half widths (below, above) in a length class and
#: in a whole language; None: no bound).
#: The floor of characters per token is a share of the median, the others are absolute.
MEASURES = {
    "chars_per_piece": (200, (0.10, 0.15), (0.20, 0.30)),
    "chars_per_rank": (200, (0.10, 0.15), (0.20, 0.30)),
    "byte_share": (2000, (None, 0.03), (None, 0.06)),
    "token_entropy": (100, (0.60, 1.0), (1.5, 2.0)),
}
RELATIVE = {"chars_per_piece", "chars_per_rank"}
#: Interquartile ranges a band reaches to either side of the median.
REACH = 4.0
#: The band of the language counts as so many texts beside those of a length class.
LEAN = 20

FEATURES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, "
    "n_pieces long, chars_per_piece double, chars_per_rank double, byte_share double, token_entropy double"
)


def script_of(text: str) -> str:
    """Script of most letters of a text, for texts without a language."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = {name: int(((points >= low) & (points <= high)).sum()) for name, low, high in SCRIPTS}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


class Meter:
    """Measures words once and texts from the words."""

    def __init__(self, piece_model: str, rank_file: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("fertility", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.starts, self.lengths, self.rank_tokens = (np.zeros(0, np.int64) for _ in range(3))

    def learn(self, words: list[bytes]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if not new:
            return
        texts = [w.decode("utf-8", "replace") for w in new]
        pieces = self.pieces.encode(texts, num_threads=1)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, np.fromiter((t for p in pieces for t in p), np.int32, int(lengths.sum()))])
        marked = [" " + t for t in texts]
        counts = np.fromiter((len(self.ranks.encode_ordinary(t)) for t in marked), np.int64, len(marked))
        self.rank_tokens = np.concatenate([self.rank_tokens, counts])
        for w in new:
            self.index[w] = len(self.index)

    def measure(self, texts: list[str]) -> list[np.ndarray]:
        """Columns after doc_id, for a few texts."""
        split = [t.encode("utf-8", "replace").split() for t in texts]
        if len(self.index) > MEMORY_WORDS:
            self.forget()
        self.learn([w for words in split for w in words])
        n = np.array([len(words) for words in split], np.int64)
        ids = np.fromiter((self.index[w] for words in split for w in words), np.int64, int(n.sum()))
        chars = np.array([len(t) - sum(map(t.count, BLANK_CHARS)) for t in texts], np.int64)
        symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
        repeats = np.array([repeated_words(part) for part in np.split(ids, np.cumsum(n)[:-1])], np.int64)
        of_doc = np.repeat(np.arange(len(texts)), n)
        lengths = self.lengths[ids]
        per_doc = np.bincount(of_doc, lengths, len(texts)).astype(np.int64)
        ranks = np.bincount(of_doc, self.rank_tokens[ids], len(texts))
        ends = np.cumsum(lengths)
        at = np.arange(int(lengths.sum())) - np.repeat(ends - lengths, lengths) + np.repeat(self.starts[ids], lengths)
        tokens, token_doc = self.flat[at].astype(np.int64), np.repeat(of_doc, lengths)
        in_bytes = np.bincount(token_doc, self.is_byte[tokens], len(texts))
        pairs, counts = np.unique(token_doc * len(self.is_byte) + tokens, return_counts=True)
        pair_doc = pairs // len(self.is_byte)
        share = counts / per_doc[pair_doc]
        entropy = np.bincount(pair_doc, -share * np.log2(share), len(texts))
        whole = np.maximum(per_doc, 1)
        return [
            n, chars, symbols, np.array([duplicate_lines(t) for t in texts], np.int64), repeats,
            np.array([script_of(t) for t in texts], object), per_doc, chars / whole, chars / np.maximum(ranks, 1), in_bytes / whole, entropy,
        ]


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows found twice or more, the first ones included."""
    if len(ids) < 4:
        return 0
    if int(ids.max()) < 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # three numbers do not fit: the first two are numbered as a pair
        _, pairs = np.unique((ids[:-2] << 32) | ids[1:-1], return_inverse=True)
        windows = (pairs << 32) | ids[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift:len(ids) - 2 + shift] |= again
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(BLANK_CHARS)]
    return len(lines) - len(set(lines))


def text_hash(text: Column) -> Column:
    """Tells texts of rows that repeat an id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def features(docs: DataFrame, piece_model: str, rank_file: str) -> DataFrame:
    """Measures of every row of (doc_id, text, lang, text_hash), without a shuffle; the last two ride along."""
    names = [f.split()[0] for f in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(piece_model, rank_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            start, size = 0, 0
            for stop, one in enumerate(texts, 1):
                size += len(one)
                if size >= 6 * CHUNK_WORDS or stop == len(texts):
                    columns = meter.measure(texts[start:stop])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, stop - start), *map(pa.array, columns), *(batch.column(c).slice(start, stop - start) for c in (2, 3))], names=[*names, "lang", "text_hash"],
                    )
                    start, size = stop, 0

    return docs.select(F.col("doc_id").cast("long"), "text", "lang", "text_hash").mapInArrow(run, f"{FEATURES}, lang string, text_hash long")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(measured: DataFrame) -> DataFrame:
    """(level, kind, size_class, n, and low/high of each measure) from the texts that pass the plain rules.

    Level 0: language and length class, 1: language. Quantiles are exact on the histogram's steps;
    a histogram has a bounded number of steps whatever the corpus.
    """
    steps = {m: F.round(F.col(m) * per).cast("long") for m, (per, *_) in MEASURES.items()}
    once = measured.filter(~base_failed()).select("kind", "size_class", "n_pieces", *[c.alias(m) for m, c in steps.items()]).distinct()
    levels = F.array(*[
        F.struct(F.lit(i).alias("level"), k.alias("kind"), s.alias("size_class"))
        for i, (k, s) in enumerate([(F.col("kind"), F.col("size_class")), (F.col("kind"), F.lit(-1))])
    ])
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("step")) for m in MEASURES])
    counts = (
        once.select(F.explode(levels).alias("l"), cells.alias("cells")).select("l.*", F.explode("cells").alias("c")).select("level", "kind", "size_class", "c.*")
        .groupBy("level", "kind", "size_class", "measure", "step").agg(F.count("*").alias("n"))
    )
    group = ["level", "kind", "size_class", "measure"]
    below = F.sum("n").over(Window.partitionBy(*group).orderBy("step"))
    total = F.sum("n").over(Window.partitionBy(*group))
    quantiles = counts.withColumn("below", below).withColumn("total", total).groupBy(*group).agg(
        F.max("total").alias("n"), *[F.min(F.when(F.col("below") * 4 >= F.col("total") * q, F.col("step"))).alias(f"q{q}") for q in (1, 2, 3)],
    )
    bounds = []
    for m, (per, *floors) in MEASURES.items():
        under, over = (F.when(F.col("level") == 0, F.lit(a)).otherwise(F.lit(b)) for a, b in zip(*floors))
        middle, spread = F.col("q2") / per, REACH * (F.col("q3") - F.col("q1")) / per
        unit = middle if m in RELATIVE else F.lit(1.0)
        low = F.lit(float("-inf")) if floors[0][0] is None else middle - F.greatest(spread, under * unit)
        high = middle + F.greatest(spread, over * unit)
        of = F.col("measure") == m
        bounds += [F.max(F.when(of, low)).alias(f"low_{m}"), F.max(F.when(of, high)).alias(f"high_{m}")]
    return quantiles.groupBy("level", "kind", "size_class").agg(F.max("n").alias("n"), *bounds)


def judged(
    docs: DataFrame, piece_model: str, rank_file: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """One row per document: counts, measures, ``base_failed``, ``kept`` and the measures out of band.

    A null text has no words and fails. A null or blank language falls back to the script. Failing texts
    of a language in which no text passes the plain rules have no band to be out of. Rows that
    repeat an id are judged each on its own; an empty table gives an empty result.
    """
    rows = features(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.trim(F.col(f"`{lang_col}`").cast("string")).alias("lang"), text_hash(F.col(f"`{text_col}`")).alias("text_hash"),
    ), piece_model, rank_file)
    measured = staged(
        rows.withColumn("kind", F.coalesce(F.when(F.col("lang") != "", F.col("lang")), F.concat(F.lit("script "), "script")))
        .withColumn("size_class", F.floor(2 * F.log2(F.greatest(F.col("n_pieces"), F.lit(1)))).cast("int")), "fertility",
    )
    limits = staged(bands(measured), "fertility-bands")

    sides = [f"{side}_{m}" for m in MEASURES for side in ("low", "high")]
    wide = limits.filter("level = 1").select(F.col("kind").alias("_k1"), F.struct(*sides).alias("_b1"))
    leaning = [((F.col("n") * F.col(c) + LEAN * F.col(f"_b1.{c}")) / (F.col("n") + LEAN)).alias(c) for c in sides]
    narrow = limits.filter("level = 0").join(wide, F.col("kind") == F.col("_k1")).select(
        F.col("kind").alias("_k0"), F.col("size_class").alias("_s0"), F.struct(*leaning).alias("_b0"),
    )
    joined = (
        measured.join(narrow, same([F.col("kind"), F.col("size_class")], [F.col("_k0"), F.col("_s0")]), "left")
        .join(wide, F.col("kind").eqNullSafe(F.col("_k1")), "left")
        .withColumn("_band", F.coalesce("_b0", "_b1"))
    )
    outside = F.array_compact(F.array(*[
        F.when((F.col(m) < F.col(f"_band.low_{m}")) | (F.col(m) > F.col(f"_band.high_{m}")), F.lit(m)) for m in MEASURES
    ]))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & (F.size(outside) == 0)).alias("kept"), *MEASURES, F.concat_ws(",", outside).alias("out_of_band"), "text_hash",
    )
