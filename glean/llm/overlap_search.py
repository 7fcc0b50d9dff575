"""T-occurrence search: the sets of an index that share enough elements with a query (DivideSkip).

The index holds an inverted list of set numbers for every element. A query of n
elements looks into the lists of its own elements, and a set that reaches the overlap T
stands in T of them. The L longest lists are put aside; the others are merged by a heap
that skips ahead, giving the sets that stand in at least T - L of them, and these are
looked up in the long lists by binary search. Sets are numbered by size, so each list is
first cut to the sizes that can be similar enough.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np

#: Cost of a binary search as against a step of the merge: long lists are put aside only where that saves.
PROBE = 8
#: Share of the lists put aside, by the length of the longest one.
SKIP = 0.01
#: Entries that the heap merges; more are merged as sorted runs, with the same counts.
HEAP = 2000
#: Long lists looked up at once, before sets that can no longer reach the overlap are left out.
STRIDE = 32


class Index:
    """Inverted lists of distinct elements of several sets."""

    def __init__(self, elements: np.ndarray, sizes: np.ndarray):
        """``elements``: those of all sets, one set after the other; ``sizes``: how many each has."""
        self.by_size = np.argsort(sizes, kind="stable")
        number = np.empty(len(sizes), np.int64)
        number[self.by_size] = np.arange(len(sizes))
        self.sizes, self.n = sizes[self.by_size], len(sizes)
        of = np.repeat(number, sizes)
        order = np.lexsort((of, elements))
        self.sets = of[order]
        self.elements, first = np.unique(elements[order], return_index=True)
        self.keys = np.repeat(np.arange(len(self.elements)), np.diff(np.r_[first, len(order)])) * self.n + self.sets

    def search(self, query: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the order given) and overlaps of the sets with 100 * overlap >= percent * union."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = len(query)
        least = -(-percent * size // 100)  # overlap with the smallest set that can be similar
        low, high = np.searchsorted(self.sizes, [least, 100 * size // percent + 1])
        at = np.minimum(np.searchsorted(self.elements, query), len(self.elements) - 1)
        known = at[self.elements[at] == query] if len(self.elements) else none[0]
        if high <= low or len(known) < least:
            return none
        start, stop = np.searchsorted(self.keys, known * self.n + low), np.searchsorted(self.keys, known * self.n + high)
        some = stop > start
        if some.sum() < least:
            return none
        order = np.argsort(start[some] - stop[some], kind="stable")  # longest first
        start, stop, known = start[some][order], stop[some][order], known[some][order]
        long = self._long(stop - start, least, high - low)
        sets, count = self._merge(start[long:], stop[long:], least - long)
        need = -(-percent * (size + self.sizes[sets]) // (100 + percent))
        for k in range(0, long, STRIDE):
            alive = count + long - k >= need
            sets, count, need = sets[alive], count[alive], need[alive]
            if not len(sets):
                break
            keys = known[k : min(k + STRIDE, long)][:, None] * self.n + sets
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            count = count + (self.keys[found] == keys).sum(0)
        alive = count >= need
        return self.by_size[sets[alive]], count[alive]

    def _long(self, lengths: np.ndarray, least: int, most: int) -> int:
        """How many of the longest lists to put aside."""
        long = int(min(least - 1, len(lengths) - 1, least / (SKIP * math.log2(lengths[0]) + 1)))
        total = np.cumsum(lengths)
        merged = int(total[-1] - (total[long - 1] if long else 0))
        candidates = min(most, merged // max(least - long, 1))
        return long if long > 0 and candidates * long * PROBE < total[long - 1] else 0

    def _merge(self, start: np.ndarray, stop: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(sets, count) of the sets that stand in at least ``least`` of the lists."""
        if (stop - start).sum() > HEAP:
            count = np.bincount(np.concatenate([self.sets[a:b] for a, b in zip(start, stop)]))
            sets = np.flatnonzero(count >= least)
            return sets, count[sets]
        found = list(_skipping([self.sets[a:b].tolist() for a, b in zip(start, stop)], least))
        made = np.array(found, np.int64).reshape(-1, 2)
        return made[:, 0], made[:, 1]


def _skipping(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """Merge ascending lists by a heap; tell the values that stand in at least ``least`` of them, and in how many.

    A value met fewer times cannot be one. Then the heap's next smallest entries go too,
    until only ``least`` - 1 lists are out; whatever these hold below the new smallest
    value stands in too few lists, and is skipped by binary search.
    """
    heap, place = [(x[0], i) for i, x in enumerate(lists) if x], [0] * len(lists)
    heapq.heapify(heap)
    while len(heap) >= least:
        value, out = heap[0][0], []
        while heap and heap[0][0] == value:
            out.append(heapq.heappop(heap)[1])
        if len(out) >= least:
            yield value, len(out)
            beyond = value + 1
        else:
            while heap and len(out) < least - 1:
                out.append(heapq.heappop(heap)[1])
            if not heap:
                return
            beyond = heap[0][0] if len(out) == least - 1 else value + 1
        for i in out:
            x = lists[i]
            place[i] = at = bisect_left(x, beyond, place[i])
            if at < len(x):
                heapq.heappush(heap, (x[at], i))
