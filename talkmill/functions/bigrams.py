"""Character bigrams of pairs of texts, compared in numpy.

Cut out by regular expressions every bigram would be a string of its own; here the bigrams of all
texts of a batch are numbers in one array, and one sort finds the different ones.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# Sent to the executors by value, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text compared in one go, besides a longer pair.
CHUNK = 1 << 20


def _code_points(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after the other and how many each text has."""
    body = b"".join(texts)
    ends = np.cumsum([0, *map(len, texts)])
    if body.isascii():
        return np.frombuffer(body, np.uint8), np.diff(ends)
    try:
        points = np.frombuffer(body.decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        return _code_points([t.decode("utf-8", "replace").encode("utf-8") for t in texts])
    # Every byte but the continuing ones begins a character.
    begun = np.cumsum(np.concatenate([[0], (np.frombuffer(body, np.uint8) & 0xC0) != 0x80]))
    return points, np.diff(begun[ends])


def _pairs(symbols: np.ndarray, lengths: np.ndarray, kinds: int) -> np.ndarray:
    """The different (text, bigram) of some texts as sorted numbers."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = text[1:] == text[:-1]
    codes = ((text[1:] * kinds + symbols[:-1]) * kinds + symbols[1:])[inside]
    codes.sort()
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes


def shares(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Per pair the Jaccard similarity of the sets of bigrams: 1 if both are empty, 0 if just one text is blank."""
    n = len(left)
    points, lengths = _code_points([*left, *right])
    present = np.zeros(0x110000, bool)
    present[points] = True
    kinds = int(present.sum())
    symbols = (np.cumsum(present) - 1)[points]
    cut = int(lengths[:n].sum())
    a, b = _pairs(symbols[:cut], lengths[:n], kinds), _pairs(symbols[cut:], lengths[n:], kinds)
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = both[1:][both[1:] == both[:-1]]
    space = max(kinds * kinds, 1)
    shared = np.bincount(common // space, minlength=n)
    total = np.bincount(a // space, minlength=n) + np.bincount(b // space, minlength=n) - shared
    share = np.where(total == 0, 1.0, shared / np.maximum(total, 1))
    return np.where((lengths[:n] == 0) != (lengths[n:] == 0), 0.0, share)


def _compared(left: list[bytes | None], right: list[bytes | None]) -> Iterator[np.ndarray]:
    start, size = 0, 0
    for stop, (a, b) in enumerate(zip(left, right), 1):
        size += len(a) + len(b)
        if size >= CHUNK or stop == len(left):
            yield shares(left[start:stop], right[start:stop])
            start, size = stop, 0


_UDF: list = []


def shared_bigrams(texts: Column) -> Column:
    """Similarity of the two fields of a struct of texts; a null struct gives null."""
    if not _UDF:
        @F.arrow_udf("double")
        def compare(pairs: pa.Array) -> pa.Array:
            there = pairs.is_valid()
            left, right = (pa.compute.cast(pairs.filter(there).field(i), pa.binary()).to_pylist() for i in (0, 1))
            out = np.zeros(len(pairs))
            out[there.to_numpy(zero_copy_only=False)] = np.concatenate([np.zeros(0), *_compared(left, right)])
            return pa.array(out, mask=~there.to_numpy(zero_copy_only=False))

        _UDF.append(compare)
    return _UDF[0](texts)
