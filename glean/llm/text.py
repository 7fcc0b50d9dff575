"""Word splitting and hashing of Arrow text columns, shared by the operators.

A word is a maximal run of anything but the six ASCII white-space characters
(``[^\\x20\\x09-\\x0D]+``). Null text has no words. Everything here works on one
slice of a partition at a time, so memory is bounded by ``SLICE_BYTES`` and the
longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: The word pattern for Spark's and DuckDB's regular expressions.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Text bytes handled at once inside a task.
SLICE_BYTES = 8 << 20
_ODD = (1 << 64) - 59
_MASK = (1 << 64) - 1


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            yield batch.slice(int(a), int(b - a))
        pa.default_memory_pool().release_unused()


@dataclass
class Words:
    """Words of several texts: ``codes[starts[i]:starts[i + 1]]`` are those of row i."""

    starts: np.ndarray
    codes: np.ndarray
    vocab: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)

    def hashes(self, salt: str = "glean-words-key1") -> np.ndarray:
        """A 64-bit hash of each word; the 16-character salt picks the function."""
        return hash_strings(self.vocab, salt)[self.codes]


def hash_strings(values: pa.Array, salt: str = "glean-words-key1") -> np.ndarray:
    if not len(values):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False), hash_key=salt, categorize=False)


def one_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def split_words(text: pa.Array) -> Words:
    """Split every text of an Arrow string column into words."""
    lists = one_array(pc.ascii_split_whitespace(pc.fill_null(text, "")))
    starts = np.asarray(lists.offsets, dtype=np.int64)
    coded = one_array(pc.dictionary_encode(lists.values))
    codes = np.asarray(coded.indices, dtype=np.int64)
    blank = np.flatnonzero(np.asarray(pc.binary_length(coded.dictionary)) == 0)
    if len(blank):
        keep = codes != blank[0]
        starts = np.r_[0, np.cumsum(keep)][starts]
        codes = codes[keep]
    return Words(starts, codes, coded.dictionary)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a finaliser of the multiply-and-shift kind)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(x: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every ``width`` consecutive values, by doubling.

    Windows that cross a text's end must be masked by the caller.
    """
    total = max(0, len(x) - width + 1)
    out, done, power, span, left = None, 0, x, 1, width
    while left:
        if left & 1:
            piece = power[done : done + total]
            out = piece if out is None else out * np.uint64(pow(_ODD, span, 1 << 64)) + piece
            done += span
        left >>= 1
        if left:
            n = max(0, len(power) - span)
            power = power[:n] * np.uint64(pow(_ODD, span, 1 << 64)) + power[span : span + n]
            span *= 2
    return mix(out[:total])


def windows_inside(words: Words, width: int) -> np.ndarray:
    """Starts (indices into all words) of the windows that lie within one text."""
    ends = np.repeat(words.starts[1:], words.counts)
    return np.flatnonzero(np.arange(len(ends)) + width <= ends)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of several ranges, one after the other."""
    total = int(counts.sum())
    begin = np.cumsum(counts) - counts
    return np.repeat(starts - begin, counts) + np.arange(total)


def as_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values, kind))
