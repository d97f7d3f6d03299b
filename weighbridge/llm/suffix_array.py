"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

A suffix is smaller (S) or larger (L) than the one after it; an S suffix after an L
suffix is leftmost-smaller.  Leftmost-smaller substrings are sorted by induction and
named; where names repeat, the string of names is sorted by the same function.  From
the order of the leftmost-smaller suffixes all others are induced in two scans.

A scan is linear and goes slot by slot; here it takes all slots up to the first one
that is still open at once, as no later slot can change them.
"""

from __future__ import annotations

import numpy as np

_STEP = 64


def _within(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by group, each one's place in its group, and the groups with their sizes."""
    order = groups.argsort(kind="stable")
    own = groups[order]
    edge = np.ones(len(own) + 1, bool)
    np.not_equal(own[1:], own[:-1], out=edge[1:-1])
    first = edge.nonzero()[0]
    sizes = first[1:] - first[:-1]
    first = first[:-1]
    return order, np.arange(len(own)) - first.repeat(sizes), own[first], sizes


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one is larger than the empty suffix."""
    n = len(text)
    up, down = np.zeros(n, bool), np.zeros(n, bool)
    up[:-1], down[:-1] = text[:-1] < text[1:], text[:-1] > text[1:]
    down[-1] = True
    decided = np.where(up | down, np.arange(n), n)
    return up[np.minimum.accumulate(decided[::-1])[::-1]]


def _induced(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the leftmost-smaller ones, given in order, induce."""
    n = len(text)
    ends = np.cumsum(counts)
    heads, tail = ends - counts, ends.copy()
    larger = counts - np.bincount(text[smaller], minlength=len(counts))
    order = np.full(n, -1, np.int32)
    of_larger = np.zeros(n, bool)  # their slots lie first in each bucket
    if len(leftmost):
        chars = text[leftmost]
        by, place, found, sizes = _within(chars)
        order[np.repeat(ends[found] - sizes, sizes) + place] = leftmost[by]
    total = int(larger.sum())
    if total:
        of_larger[np.repeat(heads - (np.cumsum(larger) - larger), larger) + np.arange(total)] = True

    open_ = of_larger.copy()
    head = heads.copy()
    last = text[n - 1]  # induced by the empty suffix
    order[head[last]], open_[head[last]] = n - 1, False
    head[last] += 1
    at, step = 0, _STEP
    while at < n:
        until = _first(open_, at, step)
        step = max(_STEP, 2 * (until - at))
        some = order[at:until]
        some = some[some > 0] - 1
        some = some[~smaller[some]]
        if len(some):
            by, place, found, sizes = _within(text[some])
            where = head[found].repeat(sizes) + place
            order[where], open_[where] = some[by], False
            head[found] += sizes
        at = until

    order[~of_larger] = -1
    open_ = ~of_larger[::-1]  # seen from the right
    at, step = 0, _STEP
    while at < n:
        until = _first(open_, at, step)
        step = max(_STEP, 2 * (until - at))
        some = order[n - until : n - at][::-1]
        some = some[some > 0] - 1
        some = some[smaller[some]]
        if len(some):
            by, place, found, sizes = _within(text[some])
            where = tail[found].repeat(sizes) - 1 - place
            order[where], open_[n - 1 - where] = some[by], False
            tail[found] -= sizes
        at = until
    return order


def _first(open_: np.ndarray, at: int, step: int) -> int:
    """The first open slot from ``at`` on, or the end."""
    n = len(open_)
    while at < n:
        part = open_[at : at + step]
        k = int(part.argmax())
        if part[k]:
            return at + k
        at += step
        step *= 2
    return n


def suffix_array(text: np.ndarray, letters: int = 256) -> np.ndarray:
    """Starts of all suffixes of ``text`` (numbers below ``letters``) in lexicographic order."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    smaller = _smaller(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + np.int32(1)
    counts = np.bincount(text, minlength=letters)
    if len(leftmost) > 1:
        order = _induced(text, smaller, leftmost, counts)
        is_leftmost = np.zeros(n, bool)
        is_leftmost[leftmost] = True
        found = order[is_leftmost[order]]
        length = np.zeros(n, np.int64)
        length[leftmost] = np.diff(leftmost, append=n + 1) + 1  # up to the next one, itself included; the last one's is its own
        a, b = found[:-1], found[1:]
        same = length[a] == length[b]
        pick = np.flatnonzero(same)
        if len(pick):
            sizes = length[a[pick]]
            first = np.cumsum(sizes) - sizes
            offset = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            equal = text[np.minimum(np.repeat(a[pick], sizes) + offset, n - 1)] == text[np.minimum(np.repeat(b[pick], sizes) + offset, n - 1)]
            same[pick] = np.logical_and.reduceat(equal, first)
        names = np.zeros(n, np.int32)
        names[found] = np.concatenate(([0], np.cumsum(~same)))
        different = int(names[found[-1]]) + 1
        if different < len(leftmost):
            leftmost = leftmost[suffix_array(names[leftmost], different)]
        else:
            leftmost = found
    return _induced(text, smaller, leftmost, counts)


def common_prefixes(text: np.ndarray, order: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each suffix in ``order``, the length of what it has in common with the one before it, at most ``room`` of it.

    room: bytes left up to the end of the piece that the suffix starts in.  Prefixes are
    computed in text order, where each is at least the one before less one, and only those
    with another byte before them, or at the start of a piece, are compared at all.
    """
    n = len(order)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = (before[1:] <= 0) | (before[:-1] < 0) | (room[1:] != room[:-1] - 1) | (text[:-1] != text[np.maximum(before[1:], 1) - 1])
    start = np.flatnonzero(fresh)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = text
    words = np.ndarray((n + 8,), "<u8", padded.data, 0, (1,))
    common = np.zeros(n, np.int64)
    active = start[before[start] >= 0]
    off = 0
    while len(active):
        x = words[np.minimum(active + off, n + 7)] ^ words[np.minimum(before[active] + off, n + 7)]
        same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
        common[active] += same
        off += 8
        active = active[(x == 0) & (off < room[active])]
    since = np.maximum.accumulate(np.where(fresh, at, 0))
    common = np.minimum(np.minimum(common, room), np.where(before >= 0, room[before], 0))[since] - (at - since)
    return np.maximum(common, 0)[order]
