"""Parallel scan of byte chunks with a finite automaton.

A chunk is scanned without knowing the state it is entered in: it tells, for every
state, in which state it is left and how many units begin in it. Such summaries
compose associatively, so chunks can be scanned anywhere and in any order; composed
in the order of the text they give each chunk's entry state and the number of units
before it, and with those the n-th unit is found inside one chunk alone.

Inside a chunk the same is done once more: blocks of ``BLOCK`` bytes are summarised
by a tree of compositions, all blocks of all chunks at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from glean.llm.text import ragged

BLOCK = 64


@dataclass(frozen=True)
class Automaton:
    """``step[state, byte]`` is the next state; ``begins[state, byte]`` tells whether the byte begins a unit.

    A text is entered in state 0. At most 32 states.
    """

    step: np.ndarray
    begins: np.ndarray

    @property
    def states(self) -> int:
        return len(self.step)


def _lines() -> Automaton:
    step, begins = np.ones((2, 256), np.uint8), np.zeros((2, 256), np.uint8)
    step[:, ord("\n")] = 0
    begins[0] = 1
    return Automaton(step, begins)


#: Lines with their line feed; 0 is the state before a line, 1 the one inside it.
LINES = _lines()


@dataclass
class Scan:
    """Summaries of the blocks of several chunks; ``first[i]`` is the first block of chunk i."""

    automaton: Automaton
    codes: np.ndarray  # blocks x BLOCK, 256 after the chunk's end
    first: np.ndarray
    count: np.ndarray
    to: list[np.ndarray]  # for each state the blocks' next state
    units: list[np.ndarray]  # for each state the units that begin in the blocks

    @classmethod
    def of(cls, automaton: Automaton, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Scan:
        """``data``: bytes; chunk i is ``data[starts[i] : starts[i] + lengths[i]]``."""
        count = -(-lengths // BLOCK)
        first = np.cumsum(count) - count
        codes = np.full(int(count.sum()) * BLOCK, 256, np.uint16)
        codes[ragged(first * BLOCK, lengths)] = data[ragged(starts, lengths)]
        n = automaton.states
        to = [np.append(automaton.step[s], s).astype(np.uint8)[codes] for s in range(n)]
        units = [np.append(automaton.begins[s], 0).astype(np.uint8)[codes] for s in range(n)]
        for _ in range(BLOCK.bit_length() - 1):
            left, right = [x[0::2] for x in to], [x[1::2] for x in to]
            more = [x[1::2] for x in units]
            units = [units[s][0::2] + np.choose(left[s], more) for s in range(n)]
            to = [np.choose(left[s], right) for s in range(n)]
        return cls(automaton, codes.reshape(-1, BLOCK), first, count, to, units)

    def enter(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """With each chunk's entry state: the state and the units before each block, and each chunk's last state and units."""
        order = np.argsort(-self.count, kind="stable")
        now, seen = state[order].astype(np.int64), np.zeros(len(order), np.int64)
        states, before = np.zeros(len(self.codes), np.uint8), np.zeros(len(self.codes), np.int64)
        to, units = np.stack(self.to, 1).ravel(), np.stack(self.units, 1).ravel().astype(np.int64)
        live, n = np.searchsorted(-self.count[order], -np.arange(int(self.count.max(initial=0))), "left"), self.automaton.states
        for j, m in enumerate(live):  # the m chunks with more than j blocks
            at = self.first[order[:m]] + j
            states[at], before[at] = now[:m], seen[:m]
            cell = at * n + now[:m]
            seen[:m] += units[cell]
            now[:m] = to[cell]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return states, before, now[back], seen[back]

    def summaries(self) -> tuple[np.ndarray, np.ndarray]:
        """(chunks x states) next states and units of each chunk for every entry state."""
        each = [self.enter(np.full(len(self.first), s))[2:] for s in range(self.automaton.states)]
        return np.stack([x[0] for x in each], 1), np.stack([x[1] for x in each], 1)

    def find(self, state: np.ndarray, chunk: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Offset in its chunk at which unit number ``unit`` (from 0, counted in the chunk) begins.

        ``state``: each chunk's entry state. The unit must begin there.
        """
        states, before, _, _ = self.enter(state)
        # the last block that has at most ``unit`` units before it; the number of a chunk sets its blocks apart
        wide = int(before.max(initial=0)) + 2 + int(unit.max(initial=0))
        keys = np.repeat(np.arange(len(self.first)), self.count) * wide + before
        block = np.searchsorted(keys, chunk * wide + unit, "right") - 1
        rest, now, out = unit - before[block], states[block].astype(np.int64), np.full(len(unit), -1)
        begins = np.concatenate([self.automaton.begins, np.zeros((self.automaton.states, 1), np.uint8)], 1)
        step = np.concatenate([self.automaton.step, np.arange(self.automaton.states)[:, None].astype(np.uint8)], 1)
        for j in range(BLOCK):
            byte = self.codes[block, j]
            new = begins[now, byte] > 0
            hit = new & (rest == 0) & (out < 0)
            out[hit] = j
            rest -= new
            now = step[now, byte].astype(np.int64)
        return (block - self.first[chunk]) * BLOCK + out


def compose(to: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry state of each chunk, units before each chunk, all units) of one text's chunks in order."""
    states, before, now, seen = [], [], 0, 0
    for t, u in zip(to.tolist(), units.tolist()):
        states.append(now)
        before.append(seen)
        seen += u[now]
        now = t[now]
    return np.array(states, np.int64), np.array(before, np.int64), seen
