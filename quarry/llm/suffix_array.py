"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as S or L; leftmost S positions cut the text into substrings, which are radix-sorted, several symbols a
digit, and named in order; the string of names is sorted by recursion, at every level in the same way. From the order of the
leftmost S suffixes that of all others is induced. Over a small alphabet two passes over the buckets do so, L suffixes and then S
suffixes; a pass handles all entries of a bucket that are known at once as one vector. Names are too many for a step a bucket:
there each suffix is radix-sorted by the symbols up to the next leftmost S suffix, whose rank decides the rest.

With `depth` the array is only sorted by prefixes of at least so many symbols: names start two apart or more, so the string of names need
be sorted by half of that, and by its single names at the end.
"""

from __future__ import annotations

import numpy as np

SMALL_ALPHABET = 1024


def _types(s: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last symbol is a sentinel smaller than all others."""
    d = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(d != 0, np.arange(len(d)), len(d))
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(d[np.minimum(nearest, len(d) - 1)] > 0, True)


def _ranked(coded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Radix sort, most significant digit first, of the substrings coded[starts:ends], where none is a proper prefix of another: for each the
    number of those that are smaller. A digit packs as many symbols as a 63-bit key holds; only substrings that are still tied go on."""
    bits = int(coded.max() + 1).bit_length()
    per = 63 // bits
    live, rank = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64)
    at = 0
    while len(live):
        first, left = starts[live] + at, ends[live] - starts[live] - at
        key = np.zeros(len(live), dtype=np.int64)
        for j in range(per):
            key <<= bits
            key += np.where(j < left, coded[np.minimum(first + j, len(coded) - 1)] + 1, 0)
        order = np.argsort(key) if not at else np.lexsort([key, rank[live]])
        group, digit = rank[live][order], key[order]
        new = np.append(True, (np.diff(digit) != 0) | (np.diff(group) != 0))
        begin = np.flatnonzero(new)[np.cumsum(new) - 1]  # of those with the same digit
        outer = np.append(True, np.diff(group) != 0)
        rank[live[order]] = group + begin - np.flatnonzero(outer)[np.cumsum(outer) - 1]
        size = np.diff(np.append(np.flatnonzero(new), len(order)))[np.cumsum(new) - 1]
        live = live[order[(size > 1) & (left[order] > per)]]
        at += per
    return rank


def _dealt(queue: dict[int, list], chars: np.ndarray, pos: np.ndarray) -> None:
    """Append positions to the queue of each one's bucket, keeping their order."""
    order = np.argsort(chars, kind="stable")
    c, p = chars[order], pos[order]
    cut = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)]
    for first, a, b in zip(c[cut[:-1]].tolist(), cut, cut[1:]):
        queue.setdefault(first, []).append(p[a:b])


def suffix_array(s: np.ndarray, depth: int = 1 << 62) -> np.ndarray:
    """s: nonnegative integers, of which the last is 0 and the only 0."""
    n = len(s)
    if n < 3:
        return np.arange(n)[::-1].copy()
    s = s.astype(np.uint16) if s.max() < 1 << 16 else s.astype(np.int64)
    kind = _types(s)
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    coded = s.astype(np.int64) * 2 + kind  # equal symbols of type L come before those of type S
    rank = _ranked(coded, lms, np.append(lms[1:] + 1, n))
    used = np.zeros(len(lms), dtype=np.int64)
    used[rank] = 1
    reduced = np.cumsum(used)[rank] - 1
    if used.all() or depth <= 2:
        order = np.argsort(reduced, kind="stable")
    else:
        order = suffix_array(reduced, depth // 2)  # the sentinel is the last leftmost substring, and has name 0
    stars = lms[order]
    top = int(s.max())
    if top >= SMALL_ALPHABET:
        # the next leftmost S position after each (the sentinel's is itself), and its rank
        follows = np.minimum(np.searchsorted(lms, np.arange(n), side="right"), len(lms) - 1)
        place = np.empty(len(lms), dtype=np.int64)
        place[order] = np.arange(len(lms))
        return np.lexsort([place[follows], _ranked(coded, np.arange(n), lms[follows] + 1)])

    def by_bucket(pos: np.ndarray) -> dict[int, np.ndarray]:
        out: dict[int, list] = {}
        _dealt(out, s[pos], pos)
        return {c: np.concatenate(x) for c, x in out.items()}

    star, none = by_bucket(stars), np.zeros(0, dtype=np.int64)
    queue: dict[int, list] = {}
    large: dict[int, np.ndarray] = {}
    for c in range(top + 1):
        front, found = np.concatenate(queue.pop(c)) if c in queue else none, []
        while len(front):
            found.append(front)
            before = front[front > 0] - 1
            before = before[~kind[before]]
            same = s[before] == c
            if not same.all():
                _dealt(queue, s[before[~same]], before[~same])
            front = before[same]
        large[c] = np.concatenate(found) if found else none
        if c in star:
            before = star[c][star[c] > 0] - 1
            before = before[~kind[before]]
            if len(before):
                _dealt(queue, s[before], before)
    queue, out = {}, []
    for c in range(top, -1, -1):
        front, found = np.concatenate(queue.pop(c)) if c in queue else none, []
        if c == 0:
            front = np.array([n - 1])
        while len(front):
            found.append(front)
            before = front[front > 0] - 1
            before = before[kind[before]]
            same = s[before] == c
            if not same.all():
                _dealt(queue, s[before[~same]], before[~same])
            front = before[same]
        back = large[c][::-1]
        before = back[back > 0] - 1
        before = before[kind[before]]
        if len(before):
            _dealt(queue, s[before], before)
        out.append(np.concatenate([*found, back]))
    return np.concatenate(out)[::-1]


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, lanes: int = 4096) -> np.ndarray:
    """Permuted longest common prefixes, up to `most` or a little more: at each position of `text` (bytes), with the suffix before it
    in `order`. The text is walked in `lanes` stretches side by side, each keeping its prefix less one from step to step."""
    n = len(text)
    phi = np.full(n, -1, dtype=np.int64)
    phi[order[1:]] = order[:-1]
    padded = np.zeros(n + most + 32, dtype=np.uint8)
    padded[:n] = text
    eight = np.ndarray(shape=(n + most + 24,), dtype="<u8", buffer=padded, strides=(1,))
    lanes = max(1, min(lanes, n // 64))
    length = -(-n // lanes)
    starts = np.arange(0, n, length)
    out, l = np.zeros(n, dtype=np.int32), np.zeros(len(starts), dtype=np.int64)
    for step in range(length):
        pos = starts + step
        pos = pos[pos < n]
        l = np.maximum(l[: len(pos)] - 1, 0)
        prev = phi[pos]
        l[prev < 0] = 0
        live = np.flatnonzero((prev >= 0) & (l < most))
        while len(live):
            x = eight[pos[live] + l[live]] ^ eight[prev[live] + l[live]]
            same = x == 0
            low = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
            l[live] += np.where(same, 8, low)
            live = live[same]
            live = live[l[live] < most]
        out[pos] = l
    return out
