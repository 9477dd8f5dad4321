"""Minimal acyclic transducers that number a sorted vocabulary.

The automaton is built from sorted terms in one pass (Daciuk et al., 2000): states below
the prefix shared with the next term can change no more and are merged with an equal state
found before.  Every arc carries how many terms lie before the ones it leads to, so the
sum along a term's path is its place in the sorted list, without the list itself.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np


class Builder:
    """States shared by all vocabularies added to it; each has a root of its own."""

    def __init__(self) -> None:
        self._known: dict[tuple, int] = {}
        self._terms: list[int] = []  # how many terms a state accepts
        self._keys: list[int] = []
        self._targets: list[int] = []
        self._adds: list[int] = []
        self._path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]
        self._last = b""

    def _freeze(self, final: bool, arcs: list[tuple[int, int]]) -> int:
        shape = (final, *arcs)
        state = self._known.get(shape)
        if state is not None:
            return state
        state = self._known[shape] = len(self._terms)
        before = int(final)
        for byte, target in arcs:
            self._keys.append(state << 8 | byte)
            self._targets.append(target)
            self._adds.append(before)
            before += self._terms[target]
        self._terms.append(before)
        return state

    def _settle(self, depth: int) -> None:
        while len(self._path) > depth + 1:
            final, arcs = self._path.pop()
            self._path[-1][1].append((self._last[len(self._path) - 1], self._freeze(final, arcs)))

    def add(self, term: bytes) -> None:
        """The next term of a vocabulary: later in byte order than the one before, not empty."""
        last, shared = self._last, 0
        if term <= last:
            raise ValueError("terms must be distinct, not empty and sorted")
        while shared < min(len(last), len(term)) and last[shared] == term[shared]:
            shared += 1
        self._settle(shared)
        self._path.extend((depth == len(term), []) for depth in range(shared + 1, len(term) + 1))
        self._last = term

    def close(self) -> int:
        """Ends a vocabulary, which may be empty; returns its root."""
        self._settle(0)
        root = self._freeze(*self._path[0])
        self._path, self._last = [(False, [])], b""
        return root

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Arcs by (state, byte): their keys, targets and additions; which states accept."""
        keys = np.array(self._keys, np.int64)
        order = np.argsort(keys)
        final = np.zeros(max(len(self._terms), 1), np.uint8)
        for shape, state in self._known.items():
            final[state] = shape[0]
        return keys[order], np.array(self._targets, np.int32)[order], np.array(self._adds, np.int32)[order], final


@dataclass
class Transducer:
    keys: np.ndarray
    targets: np.ndarray
    adds: np.ndarray
    final: np.ndarray

    @property
    def states(self) -> int:
        return len(self.final)

    def ordinals(self, root: int | np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each term's place among the sorted ones below its root, -1 for terms not there.

        A term is a run of ``data``.  All go through the automaton together, a byte at a time.
        """
        found = np.full(len(starts), -1, np.int64)
        live = np.arange(len(starts))
        state, total = np.full(len(starts), root, np.int64), np.zeros(len(starts), np.int64)
        depth = 0
        while len(live):
            ended = lengths[live] == depth
            accepted = ended & (self.final[state] > 0)
            found[live[accepted]] = total[accepted]
            live, state, total = live[~ended], state[~ended], total[~ended]
            if not len(live) or not len(self.keys):
                break
            key = state << 8 | data[starts[live] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[arc] == key
            live, arc = live[known], arc[known]
            state, total = self.targets[arc].astype(np.int64), total[known] + self.adds[arc]
            depth += 1
        return found
