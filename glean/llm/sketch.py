"""Counts of hashed values in a distributed sketch, and bounded filters of hashed values.

A sketch has 2 ** bits cells; a value's upper bound is the count of its cell. It is
never whole anywhere: a task counts its own values and sends every block of
``BLOCK`` cells on as the cells it has touched; each block is summed by one stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glean.llm.text import mix

#: Cells of a block.
BLOCK = 1 << 16
#: Distinct cells that a task holds before it sends them on.
HELD = 1 << 22
#: Counts of one task are told up to this; upper bounds are told up to four thousand million.
MOST = (1 << 16) - 1
#: A filter's bits for each of its values, its probes, and its bits at most (32 MB).
SPACE, PROBES, MOST_BITS = 32, 3, 1 << 28


def blocks_of(values: Iterator[np.ndarray], bits: int, most: int = HELD) -> Iterator[pa.RecordBatch]:
    """(block, cells, times) of the hashes in ``values``; about ``most`` cells are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for x in values:
        held.append(np.unique(x & np.uint64((1 << bits) - 1), return_counts=True))
        size += len(held[-1][0])
        if size >= most:
            held = [_merged(held)]
            size = len(held[0][0])
            if size >= most // 2:
                yield _packed(*held[0])
                held, size = [], 0
    if size:
        yield _packed(*_merged(held))


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    cells, n = (np.concatenate(x) for x in zip(*held))
    held.clear()
    order = np.argsort(cells)
    cells, n = cells[order], n[order]
    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    return cells[first], np.add.reduceat(n, first)


def _packed(cells: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    block = (cells // np.uint64(BLOCK)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    ends = np.r_[first, len(cells)].astype(np.int32)
    lists = lambda x: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((2 * ends).tobytes()), pa.py_buffer(x.astype("<u2").tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(block[first]), lists(cells % np.uint64(BLOCK)), lists(np.minimum(times, MOST))], ["block", "cells", "times"])


def summed(parts: DataFrame, least: int) -> DataFrame:
    """(cell, n): the cells whose sum over all parts is at least ``least``."""

    def told(block: int, total: np.ndarray) -> pa.RecordBatch:
        hot = np.flatnonzero(total >= least)
        return pa.RecordBatch.from_arrays([pa.array(hot + block * BLOCK), pa.array(total[hot])], ["cell", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(BLOCK, np.int64)
        for batch in batches:
            for block, cells, times in zip(*(batch.column(c) for c in ("block", "cells", "times"))):
                if block.as_py() != now:
                    if now is not None:
                        yield told(now, total)
                    now, total = block.as_py(), np.zeros(BLOCK, np.int64)
                total[np.frombuffer(cells.as_buffer(), "<u2")] += np.frombuffer(times.as_buffer(), "<u2")
        if now is not None:
            yield told(now, total)

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "block").sortWithinPartitions("block").mapInArrow(run, "cell long, n long")


class Filter:
    """Membership of hashed values, with false positives: a bit array of bounded size."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def _places(x: np.ndarray, bits: int) -> list[np.ndarray]:
        out = []
        for _ in range(PROBES):
            x = mix(x + np.uint64(0x2545F4914F6CDD1D))
            out.append(x & np.uint64(bits - 1))
        return out

    def has(self, x: np.ndarray) -> np.ndarray:
        found = np.ones(len(x), bool)
        for place in self._places(x, 64 * len(self.words)):
            found &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
        return found

    def keep(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of ``df`` whose ``column`` (a 64-bit hash) passes."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(shared.value.has(batch.column(column).to_numpy().view(np.uint64))))

        return df.mapInArrow(run, df.schema)

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Filter:
        """A filter of a column of hashes; beyond ``MOST_BITS`` only false positives grow."""
        bits = 1 << 10
        while bits < min(SPACE * df.count(), MOST_BITS):
            bits *= 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = np.concatenate(cls._places(batch.column(0).to_numpy().view(np.uint64), bits))
                yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], ["at", "bit"])

        found = df.select(column).mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[found.column("at").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
        return cls(words)
