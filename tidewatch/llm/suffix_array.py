"""Two-stage suffix sorting with numpy, for the blocks that one task of the substring dedup holds.

Only the suffixes smaller than their successors are sorted directly; a scan over the buckets of first bytes induces the
order of the rest. Both stages look ``depth`` bytes deep (a multiple of what a word holds is compared), which is all that
common prefixes of up to ``depth`` bytes need.
"""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number, zeros after the end; 64 more entries of zero."""
    n = len(text)
    raw = text.tobytes() + bytes(16)
    out = np.zeros(n + 64, dtype=np.uint64)
    for r in range(min(8, n)):
        count = (n - r + 7) // 8
        out[r:n:8] = np.frombuffer(raw, ">u8", count, r)
    return out


def ascending(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each position is smaller than its successor; the last one isn't."""
    n = len(text)
    up = np.zeros(n, dtype=bool)
    if n < 2:
        return up
    step = text[1:].astype(np.int16) - text[:-1]
    # Of equal bytes, the next different one decides.
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    up[:-1] = np.append(step, 0)[at] > 0
    return up


def sorted_directly(chosen: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """The chosen positions by the depth bytes that follow."""
    key = words[chosen]
    order = np.argsort(key)
    out, key = chosen[order], key[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    for at in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(new)[where]
        part = out[where]
        key = words[np.minimum(part + at, len(words) - 1)]
        order = np.lexsort((key, group))
        part, key = part[order], key[order]
        out[where] = part
        new[where[1:]] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    return out


def suffix_order(text: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """All positions, sorted by the suffixes' first ``depth`` bytes at least."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    up = ascending(text)
    direct = sorted_directly(np.flatnonzero(up), words, depth)
    heads = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        front = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, dtype=np.int64)
        waiting[c] = []
        bucket = []
        while len(front):  # runs of this byte induce within the bucket
            bucket.append(front)
            before = front[front > 0] - 1
            front = before[(text[before] == c) & ~up[before]]
        bucket.append(direct[heads[c] : heads[c + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[(text[before] > c) & ~up[before]]
        if len(before):
            first = text[before]
            before = before[np.argsort(first, kind="stable")]
            ends = np.cumsum(np.bincount(first, minlength=256))
            for b in np.flatnonzero(np.diff(ends, prepend=0)):
                waiting[b].append(before[ends[b - 1] if b else 0 : ends[b]])
    return np.concatenate(out)


def same_prefix(order: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Whether the common prefix of each suffix and its forerunner in the order has length bytes at least."""
    same = np.zeros(len(order), dtype=bool)
    left = np.arange(1, len(order))
    for at in range(0, length, 8):
        a, b = words[order[left] + at], words[order[left - 1] + at]
        if length - at < 8:
            rest = np.uint64(8 * (8 - (length - at)))
            a, b = a >> rest, b >> rest
        left = left[a == b]
    same[left] = True
    return same
