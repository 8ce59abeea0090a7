"""Weighted acyclic automata: sorted keys with counts, as minimal transducers from a key to its count.

A key is a tuple of labels (byte strings). Equal continuations share one state, counts included.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np

Key = tuple[bytes, ...]


class CountAutomaton:
    """State 0 of ``states`` is never used; each state is (count of the key that ends here, ((label, state), ...))."""

    def __init__(self, states: list[tuple[int, tuple[tuple[bytes, int], ...]]], root: int):
        self.states, self.root = states, root

    @classmethod
    def build(cls, counted: Iterable[tuple[Key, int]]) -> CountAutomaton:
        """From keys in strictly rising order: what lies behind a key's common prefix with the next one is finished and
        shared with an equal state, if there is one."""
        known: dict[tuple, int] = {}
        states: list[tuple] = [(0, ())]
        open_: list[tuple[list[int], list[tuple[bytes, int]]]] = [([0], [])]
        last: Key = ()

        def finish(depth: int) -> None:
            while len(open_) - 1 > depth:
                count, arcs = open_.pop()
                open_[-1][1].append((last[len(open_) - 1], share(count[0], arcs)))

        def share(count: int, arcs: list[tuple[bytes, int]]) -> int:
            state = (count, tuple(arcs))
            at = known.get(state)
            if at is None:
                at = known[state] = len(states)
                states.append(state)
            return at

        for key, count in counted:
            same, most = 0, min(len(key), len(last))
            while same < most and key[same] == last[same]:
                same += 1
            if same == len(key):
                raise ValueError("keys must rise")
            finish(same)
            for _ in key[same:]:
                open_.append(([0], []))
            open_[-1][0][0], last = count, key
        finish(0)
        return cls(states, share(open_[0][0][0], open_[0][1]))

    def __iter__(self) -> Iterator[tuple[Key, int]]:
        """All keys with their counts, rising."""
        todo: list[tuple[Key, int]] = [((), self.root)]
        while todo:
            key, at = todo.pop()
            count, arcs = self.states[at]
            if count:
                yield key, count
            todo += [((*key, label), to) for label, to in reversed(arcs)]

    @classmethod
    def union(cls, parts: list[CountAutomaton], least: int = 1) -> CountAutomaton:
        """The keys of all parts with the sums of their counts, those of at least ``least``."""
        return cls.build((k, n) for k, n in summed(heapq.merge(*parts, key=lambda x: x[0])) if n >= least)

    def compose(self, asked: CountAutomaton) -> Iterator[tuple[Key, int]]:
        """The keys of ``asked`` that are here too, with the counts they have here: both are walked together."""
        todo: list[tuple[Key, int, int]] = [((), self.root, asked.root)]
        while todo:
            key, here, there = todo.pop()
            (count, arcs), (wanted, steps) = self.states[here], asked.states[there]
            if count and wanted:
                yield key, count
            if len(steps) * 8 < len(arcs):
                to = [(label, _find(arcs, label), s) for label, s in steps]
                both = [(label, a, s) for label, a, s in to if a]
            else:
                of = dict(arcs)
                both = [(label, of[label], s) for label, s in steps if label in of]
            todo += [((*key, label), a, s) for label, a, s in reversed(both)]

    def to_bytes(self) -> bytes:
        arcs = [a for _, state in self.states for a in state]
        labels = sorted({label for label, _ in arcs})
        number = {label: k for k, label in enumerate(labels)}
        parts = [
            np.array([len(self.states), len(arcs), len(labels), self.root], np.int64),
            np.array([n for n, _ in self.states], np.int64),
            np.array([len(a) for _, a in self.states], np.int32),
            np.array([to for _, to in arcs], np.int32),
            np.array([number[label] for label, _ in arcs], np.int32),
            np.array([len(label) for label in labels], np.int32),
        ]
        return b"".join([p.tobytes() for p in parts] + labels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountAutomaton:
        n, m, k, root = np.frombuffer(raw, np.int64, 4).tolist()
        counts = np.frombuffer(raw, np.int64, n, 32).tolist()
        rest = np.frombuffer(raw, np.int32, n + 2 * m + k, 32 + 8 * n)
        sizes, to, of, lengths = np.split(rest, [n, n + m, n + 2 * m])
        ends = np.cumsum(lengths) + 32 + 8 * n + 4 * len(rest)
        labels = [raw[e - s : e] for s, e in zip(lengths.tolist(), ends.tolist())]
        arcs = list(zip([labels[x] for x in of.tolist()], to.tolist()))
        cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        return cls([(c, tuple(arcs[a:b])) for c, a, b in zip(counts, cuts, cuts[1:])], root)


def summed(rising: Iterable[tuple[Key, int]]) -> Iterator[tuple[Key, int]]:
    """Add the counts of equal neighbours."""
    key, total = None, 0
    for k, n in rising:
        if k == key:
            total += n
        else:
            if key is not None:
                yield key, total
            key, total = k, n
    if key is not None:
        yield key, total


def _find(arcs: tuple[tuple[bytes, int], ...], label: bytes) -> int:
    low, high = 0, len(arcs)
    while low < high:
        mid = (low + high) // 2
        if arcs[mid][0] < label:
            low = mid + 1
        else:
            high = mid
    return arcs[low][1] if low < len(arcs) and arcs[low][0] == label else 0
