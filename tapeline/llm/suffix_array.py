"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np


def words_at(data: np.ndarray, pad: int = 8) -> np.ndarray:
    """The 8 bytes from each position on as a big-endian number; zeros follow the end."""
    n, out = len(data), np.zeros(len(data), np.uint64)
    ext = np.concatenate((data, np.zeros(pad, np.uint8))).astype(np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | ext[k : k + n]
    return out


def refine(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and ranks, from keys of the first `width` symbols of each suffix.

    Groups of equal suffixes are split by the rank of the suffix `h` later, and h doubles; groups of
    one take no further part.
    """
    n = len(first)
    sa = np.argsort(first, kind="stable")
    key = first[sa]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    group = np.cumsum(fresh) - 1
    slot = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[sa] = slot[group]
    live = np.flatnonzero(np.diff(np.append(slot, n))[group] > 1)
    h = width
    while len(live) and h < n:
        at = sa[live]
        then = at + h
        later = np.where(then < n, rank[np.minimum(then, n - 1)] + 1, 0)
        pair = (rank[at].astype(np.uint64) << np.uint64(32)) | later.astype(np.uint64)
        order = np.argsort(pair, kind="stable")
        at, pair = at[order], pair[order]
        sa[live] = at
        fresh = np.ones(len(live), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        slot = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        rank[at] = live[slot][group]
        live = live[np.diff(np.append(slot, len(live)))[group] > 1]
        h *= 2
    return sa, rank


def common_prefixes(words: np.ndarray, sa: np.ndarray, most: int, lanes: int = 8192) -> np.ndarray:
    """For each slot of sa, the length that its suffix shares with the one before, up to `most`.

    Kasai: the text position after one that shares h shares at least h - 1. The text is cut into
    lanes that walk side by side, 8 bytes a step. words: from words_at.
    """
    n = len(sa)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    shared = np.zeros(n, np.int64)
    span = max(64, -(-n // lanes))
    at = np.arange(0, n, span)
    stop = np.minimum(at + span, n)
    h = np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        x, y = at + h, other + h
        inside = (other >= 0) & (np.maximum(x, y) < n) & (h < most)
        differ = words[np.where(inside, x, 0)] ^ words[np.where(inside, y, 0)]
        room = n - np.maximum(x, y)
        go = inside & (differ == 0) & (room >= 8)
        # equal leading bytes of the 8: from the highest differing byte
        high = np.zeros(len(at), np.int64)
        rest = differ.copy()
        for k in (32, 16, 8):
            empty = (rest >> np.uint64(64 - k)) == 0
            high += np.where(empty, k // 8, 0)
            rest = np.where(empty, rest << np.uint64(k), rest)
        high = np.where(differ == 0, 8, high)
        end = np.minimum(np.where(inside, h + np.minimum(high, room), h), n - np.maximum(at, other))
        done = ~go
        shared[at[done]] = np.where(other[done] >= 0, np.minimum(end[done], most), 0)
        h = np.where(go, h + 8, np.maximum(np.minimum(end, most) - 1, 0))
        at = at + done
        keep = at < stop
        if not keep.all():
            at, stop, h = at[keep], stop[keep], h[keep]
    out = np.empty(n, np.int64)
    out[:] = shared[sa]
    return out


def search(words: np.ndarray, sa: np.ndarray, wanted: np.ndarray, want_at: np.ndarray, length: int) -> np.ndarray:
    """For each position want_at in the text of `wanted`, the first slot of sa whose suffix is not
    below its `length` bytes. words, wanted: from words_at; a step of binary search for all at once."""
    low, high = np.zeros(len(want_at), np.int64), np.full(len(want_at), len(sa), np.int64)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        less = compare(words, sa[np.where(open_, mid, 0)], wanted, want_at, length) < 0
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return low


def compare(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1 as `length` bytes from x_at are below, equal to or above those from y_at."""
    out = np.zeros(len(x_at), np.int64)
    todo = np.arange(len(x_at))
    for k in range(0, length, 8):
        if not len(todo):
            break
        i, j = x_at[todo] + k, y_at[todo] + k
        a = np.where(i < len(x), x[np.minimum(i, len(x) - 1)], np.uint64(0))
        b = np.where(j < len(y), y[np.minimum(j, len(y) - 1)], np.uint64(0))
        if length - k < 8:
            cut = np.uint64(8 * (8 - (length - k)))
            a, b = a >> cut, b >> cut
        out[todo] = np.where(a < b, -1, np.where(a > b, 1, 0))
        todo = todo[a == b]
    return out
