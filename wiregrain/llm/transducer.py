"""A minimal acyclic transducer: a set of byte strings that tells the place of each in their order.

States that accept the same endings are one. Every arc carries how many strings come before those that pass through it, so
the numbers along a string's path add up to its ordinal. Strings are looked up many at a time, one byte of all in a step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

_U = np.uint64


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + _U(seed)) * _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        return x ^ (x >> _U(29))


@dataclass
class Transducer:
    """Arcs in a table that is addressed by a hash of state and byte; ``final`` by state."""

    keys: np.ndarray
    target: np.ndarray
    before: np.ndarray
    final: np.ndarray
    root: int
    longest: int

    @property
    def states(self) -> int:
        return len(self.final)

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next state (-1: none) and number of the arcs."""
        key = state.astype(np.int64) << 8 | byte
        slot = (_mix(key) & _U(len(self.keys) - 1)).astype(np.int64)
        found = self.keys[slot]
        open_ = np.nonzero((found != key) & (found >= 0))[0]
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found[open_] = self.keys[slot[open_]]
            open_ = open_[(found[open_] != key[open_]) & (found[open_] >= 0)]
        return np.where(found == key, self.target[slot], -1), self.before[slot]

    def walk(self, state: np.ndarray, number: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Ordinals of the strings ``data[start : start + length]``, read from the given states and numbers on; -1: not in the set."""
        out = np.full(len(start), -1, np.int64)
        own = np.nonzero((state >= 0) & (length <= self.longest))[0]
        state, number, start, length = state[own], number[own].astype(np.int64), start[own], length[own]
        at = 0
        while True:
            ends = length == at
            if ends.any():
                hit = ends & self.final[state]
                out[own[hit]] = number[hit]
                go = ~ends
                own, state, number, start, length = own[go], state[go], number[go], start[go], length[go]
            if not len(own):
                return out
            state, more = self.step(state, data[start + at])
            go = state >= 0
            own, state, number, start, length = own[go], state[go], (number + more)[go], start[go], length[go]
            at += 1


def _table(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Open addressing with linear steps, at most half full."""
    size = 1 << max(int(2 * len(keys)).bit_length(), 3)
    table = np.full(size, -1, np.int64)
    columns = [np.zeros(size, v.dtype) for v in values]
    slot = (_mix(keys) & _U(size - 1)).astype(np.int64)
    left = np.arange(len(keys))
    while len(left):
        at = slot[left]
        _, first = np.unique(at, return_index=True)
        first = first[table[at[first]] < 0]
        chosen = left[first]
        table[slot[chosen]] = keys[chosen]
        for column, value in zip(columns, values, strict=True):
            column[slot[chosen]] = value[chosen]
        left = np.delete(left, first)
        slot[left] = (slot[left] + 1) & (size - 1)
    return table, *columns


def build(strings: Sequence[bytes], seed: int = 0) -> Transducer:
    """The transducer of sorted, distinct, non-empty strings.

    The trie of all prefixes is laid out level by level (a string's new nodes start where it leaves the one before it), then
    merged from the deepest level up: nodes with equal ends and equal arcs into equal states are one state.
    """
    n = len(strings)
    length = np.fromiter(map(len, strings), np.int64, n)
    longest = int(length.max(initial=0))
    letters = np.frombuffer(b"".join(s.ljust(longest, b"\0") for s in strings), np.uint8).reshape(n, longest)
    # Shared prefixes with the string before; padding never counts.
    same = np.zeros(n, np.int64)
    if n > 1:
        equal = letters[1:] == letters[:-1]
        first = np.where(equal.all(axis=1), longest, np.argmin(equal, axis=1)) if longest else 0
        same[1:] = np.minimum(first, np.minimum(length[1:], length[:-1]))
    if (same >= length).any():
        raise ValueError("strings must be sorted, distinct and not empty")
    base = np.cumsum(length - same) - (length - same) + 1
    nodes = int((length - same).sum()) + 1
    parent, byte = np.zeros(nodes, np.int64), np.zeros(nodes, np.uint8)
    final = np.zeros(nodes, bool)
    levels: list[np.ndarray] = [np.zeros(1, np.int64)]
    above = np.zeros(n, np.int64)
    for depth in range(1, longest + 1):
        own = np.nonzero((same < depth) & (length >= depth))[0]
        ids = base[own] + depth - same[own] - 1
        parent[ids], byte[ids] = above[own], letters[own, depth - 1]
        final[ids[length[own] == depth]] = True
        here = np.zeros(n, np.int64)
        here[own] = ids
        above = np.maximum.accumulate(here)
        levels.append(ids)
    state = np.zeros(nodes, np.int64)
    words = np.zeros(nodes, np.int64)  # strings that end below a node
    signature = _mix(final, seed + 1)
    known_mark, known_state = np.empty(0, np.uint64), np.empty(0, np.int64)
    chosen: list[np.ndarray] = []
    for ids in reversed(levels):
        words[ids] += final[ids]
        mark, first, back = np.unique(signature[ids], return_index=True, return_inverse=True)
        place = np.searchsorted(known_mark, mark)
        old = place < len(known_mark)
        old[old] = known_mark[place[old]] == mark[old]
        own = np.empty(len(mark), np.int64)
        own[old] = known_state[place[old]]
        fresh = np.nonzero(~old)[0]
        own[fresh] = len(known_mark) + np.arange(len(fresh))
        chosen.append(ids[first[fresh]])
        known_mark = np.insert(known_mark, place[fresh], mark[fresh])
        known_state = np.insert(known_state, place[fresh], own[fresh])
        state[ids] = own[back]
        inner = ids[ids > 0]
        with np.errstate(over="ignore"):
            np.add.at(signature, parent[inner], _mix(state[inner] << 8 | byte[inner], seed + 2))
        np.add.at(words, parent[inner], words[inner])
    chosen_nodes = np.concatenate(chosen)  # in order of states
    # Arcs of one node for each state, in order of bytes, with the strings before each.
    named = np.zeros(nodes, bool)
    named[chosen_nodes] = True
    arcs = np.nonzero(named[parent] & (np.arange(nodes) > 0))[0]
    arcs = arcs[np.lexsort((byte[arcs], parent[arcs]))]
    running = np.cumsum(words[arcs]) - words[arcs]
    heads = np.nonzero(np.diff(parent[arcs], prepend=-1))[0]
    start = np.repeat(running[heads], np.diff(np.append(heads, len(arcs))))
    before = running - start + final[parent[arcs]]
    keys = state[parent[arcs]] << 8 | byte[arcs]
    table, target, number = _table(keys, state[arcs].astype(np.int32), before.astype(np.int32))
    ends = final[chosen_nodes]
    made = Transducer(table, target, number, ends, int(state[0]), longest)
    # Marks are hashes: every node must have the end and the arcs of its state.
    inner = np.arange(1, nodes)
    fan = np.bincount(parent[1:], minlength=nodes)
    to, _ = made.step(state[parent[inner]], byte[inner])
    if (to != state[inner]).any() or (ends[state] != final).any() or (fan != fan[chosen_nodes][state]).any():
        return build(strings, seed + 17)
    return made
