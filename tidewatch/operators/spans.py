"""Spans of time by key, as arrays: unions, overlaps, and how many are there at a moment.

Times are ranks, from 0 to ``top``; a span is from its start to just before its end. Keys and ranks are ordered as one number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Spans = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Clock:
    top: int

    def at(self, key: np.ndarray, time: np.ndarray) -> np.ndarray:
        return key * (self.top + 1) + time

    def apart(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.divmod(at, self.top + 1)

    def union(self, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> Spans:
        """The spans of each key as disjoint ones, in order."""
        order = np.argsort(self.at(key, start), kind="stable")
        key, start, end = key[order], start[order], end[order]
        if not len(key):
            return key, start, end
        reach = np.maximum.accumulate(self.at(key, end))
        first = np.flatnonzero(np.concatenate(([True], self.at(key, start)[1:] > reach[:-1])))
        return key[first], start[first], self.apart(reach[np.append(first[1:], len(key)) - 1])[1]

    def levels(self, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Disjoint spans of each key in which the number of its spans is the same, above 0, and that number."""
        at, back = np.unique(np.concatenate((self.at(key, start), self.at(key, end))), return_inverse=True)
        n = np.cumsum(np.bincount(back, np.repeat([1, -1], len(key)), len(at)).astype(np.int64))
        some = np.flatnonzero(n > 0)
        (owner, a), b = self.apart(at[some]), self.apart(at[some + 1])[1] if len(some) else some
        return owner, a, b, n[some]

    def overlaps(self, key: np.ndarray, start: np.ndarray, end: np.ndarray, others: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where spans overlap others of their key, which are disjoint and in order: places in both, start and end."""
        low = np.searchsorted(self.at(others[0], others[2]), self.at(key, start), "right")
        n = np.maximum(np.searchsorted(self.at(others[0], others[1]), self.at(key, end), "left") - low, 0)
        own = np.repeat(np.arange(len(key)), n)
        other = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + low[own]
        return own, other, np.maximum(start[own], others[1][other]), np.minimum(end[own], others[2][other])

    def present(self, key: np.ndarray, start: np.ndarray, end: np.ndarray, *weights: np.ndarray) -> Present:
        return Present(self, key, start, end, weights)


class Present:
    """How many spans of a key there are at a moment, or the sums of their weights."""

    def __init__(self, clock: Clock, key: np.ndarray, start: np.ndarray, end: np.ndarray, weights: tuple[np.ndarray, ...]) -> None:
        self.clock, self.sides = clock, []
        for time in (start, end):
            at = clock.at(key, time)
            order = np.argsort(at, kind="stable")
            self.sides.append((at[order], [np.concatenate(([0], np.cumsum(x[order]))) for x in weights]))

    def at(self, key: np.ndarray, time: np.ndarray) -> list[np.ndarray]:
        """The number of spans, then the sums of the weights."""
        at = self.clock.at(key, time)
        (come, came), (go, gone) = self.sides
        a, b = np.searchsorted(come, at, "right"), np.searchsorted(go, at, "right")
        return [a - b, *(x[a] - y[b] for x, y in zip(came, gone, strict=True))]
