"""Suffix arrays by induced sorting and permuted common prefixes, on arrays of small integers.

Induced sorting looks sequential, but all suffixes that begin with one character
can be handled together: they induce the order of the suffixes one place to the
left, and only those with the same first character come back to the same bucket.
So each bucket is a few array operations, repeated as often as a character is
repeated in a row.
"""

from __future__ import annotations

import numpy as np

# Below this length sorting growing prefixes is quicker than another round of induction.
_SMALL = 1 << 17
_SLICE = 1 << 15


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last, a unique smallest, counts as such."""
    n = len(s)
    sign = np.sign(np.diff(s.astype(np.int32))).astype(np.int8)
    at = np.where(sign != 0, np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
    following = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.ones(n, bool)
    inside = following < n - 1
    smaller[:-1][inside] = sign[following[inside]] > 0
    return smaller


def _induce(s: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, size: int) -> np.ndarray:
    """Order of all suffixes, given the leftmost smaller ones in (some) order."""
    n = len(s)
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    order = np.full(n, -1, np.int32)
    chars = s[leftmost]
    grouped = leftmost[np.argsort(chars, kind="stable")]
    seeds = np.bincount(chars, minlength=size)
    seed_at = np.concatenate([[0], np.cumsum(seeds)])

    def put(found, place, step):
        """Append suffixes to their buckets, forwards or backwards, in the order given."""
        c = s[found]
        by = np.argsort(c, kind="stable")
        c, found = c[by], found[by]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        many = np.diff(np.append(first, len(c)))
        offset = np.arange(len(c)) - np.repeat(first, many)
        order[place[c] + step * offset] = found
        place[c[first]] += step * many

    heads = starts.copy()
    for c in np.flatnonzero(counts):
        done = starts[c]
        while True:
            upto = heads[c]
            if done == upto:
                break
            left = order[done:upto] - 1
            done = upto
            left = left[left >= 0]
            left = left[~smaller[left]]
            if len(left):
                put(left, heads, 1)
        left = grouped[seed_at[c] : seed_at[c + 1]] - 1
        left = left[left >= 0]
        left = left[~smaller[left]]
        if len(left):
            put(left, heads, 1)
    tails = ends - 1
    larger_end = heads
    for c in np.flatnonzero(counts)[::-1]:
        done = ends[c] - 1
        while True:
            upto = tails[c]
            if done == upto:
                break
            left = order[upto + 1 : done + 1][::-1] - 1
            done = upto
            left = left[left >= 0]
            left = left[smaller[left]]
            if len(left):
                put(left, tails, -1)
        left = order[starts[c] : larger_end[c]][::-1] - 1
        left = left[left >= 0]
        left = left[smaller[left]]
        if len(left):
            put(left, tails, -1)
    # The sentinel induces its left neighbour but is induced by nothing.
    order[0] = n - 1
    return order


def _doubling(s: np.ndarray) -> np.ndarray:
    """Suffix array of a short array, by sorting ranks of growing prefixes."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    n, step = len(s), 1
    while True:
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:] if step < n else 0
        key = rank * (n + 1) + ahead + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, step = new, step * 2
        if rank.max() == n - 1 or step >= n:
            return order


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """Order of the suffixes of ``s``: values below ``size``, the last one 0 and unique."""
    if len(s) < _SMALL:
        return _doubling(s)
    s = s.astype(np.uint16)
    smaller = _types(s)
    leftmost = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    order = _induce(s, smaller, leftmost, size)
    is_leftmost = np.zeros(len(s), bool)
    is_leftmost[leftmost] = True
    ranked = order[is_leftmost[order]]
    # Name the leftmost smaller substrings; equal ones, compared character by character, share a name.
    length = np.zeros(len(s), np.int32)
    length[leftmost] = np.diff(np.append(leftmost, len(s) - 1)) + 1
    a, b = ranked[:-1], ranked[1:]
    differs = length[a] != length[b]
    live = np.flatnonzero(~differs)
    for k in range(int(length.max(initial=0))):
        live = live[length[a[live]] > k]
        if not len(live):
            break
        unlike = s[a[live] + k] != s[b[live] + k]
        differs[live[unlike]] = True
        live = live[~unlike]
    names = np.zeros(len(s), np.int32)
    names[ranked] = np.concatenate([[0], np.cumsum(differs)])
    if not differs.all():
        # Two digits a name keep the number of buckets small; the order of the whole names is the same.
        reduced = names[leftmost]
        base = int(np.sqrt(reduced.max() + 1)) + 1
        digits = np.empty(2 * len(reduced) + 1, np.uint16)
        digits[0:-1:2], digits[1:-1:2], digits[-1] = reduced // base + 1, reduced % base + 1, 0
        sub = suffix_array(digits, base + 2)
        sub = sub[(sub % 2 == 0) & (sub < len(digits) - 1)] // 2
        ranked = leftmost[sub]
    return _induce(s, smaller, ranked, size)


def permuted_common_prefixes(s: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the length it shares with the suffix before it in the order, and where that one is (-1: none).

    Where the characters before both agree, the value is one less than at the place
    before; only the other places are compared, in growing steps.
    """
    n = len(s)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    i = np.arange(n, dtype=np.int32)
    free = (i == 0) | (before <= 0)
    inner = np.flatnonzero(~free)
    free[inner] = s[inner - 1] != s[before[inner] - 1]
    del inner
    place = np.flatnonzero(free & (before >= 0))
    other = before[place]
    shared = np.zeros(len(place), np.int32)
    padded = np.concatenate([s.astype(np.int32), np.full(64, -1, np.int32)])
    # A slice of the places at a time: the tables of a step hold up to 64 numbers a place.
    for begin in range(0, len(place), _SLICE):
        live, step = np.arange(begin, min(begin + _SLICE, len(place))), 4
        while len(live):
            room = n - np.maximum(place[live], other[live]) - shared[live]
            at = np.arange(step, dtype=np.int32)
            x = padded[np.minimum((place[live] + shared[live])[:, None] + at, n)]
            y = padded[np.minimum((other[live] + shared[live])[:, None] + at, n)]
            same = (x == y) & (at < room[:, None])
            run = np.where(same.all(axis=1), step, same.argmin(axis=1))
            shared[live] += run
            live = live[run == step]
            step = min(64, step * 2)
    best = np.full(n, -1, np.int32)
    best[free] = i[free]
    best[place] = place + shared
    return np.maximum.accumulate(best) - i, before
