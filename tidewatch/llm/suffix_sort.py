"""Suffix sorting by hash comparison.

Prefix sums of a polynomial hash give the hash of any substring at once, and a
binary search over lengths the longest common extension of two suffixes, so a
comparison takes a logarithmic number of steps. Suffixes are merge-sorted with
it; all comparisons of a step are made together in numpy.
"""

from __future__ import annotations

import numpy as np

from .inverted_index import BYTE_VALUE

BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class PrefixHash:
    """Hashes of the substrings of a byte array, modulo 2 ** 64."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUE[data] * _powers(BASE, len(data)))])
        self.scale = _powers(INVERSE, len(data) + 1)

    def of(self, begin: np.ndarray, length) -> np.ndarray:
        return (self.sums[begin + length] - self.sums[begin]) * self.scale[begin]

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b, at most ``most``."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.of(a, mid) == self.of(b, mid)
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, length_a: np.ndarray, b: np.ndarray, length_b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before suffix b; equal ones do where ``or_equal``."""
        most = np.minimum(length_a, length_b)
        n = self.extension(a, b, most)
        last = len(self.data) - 1
        x, y = self.data[np.minimum(a + n, last)], self.data[np.minimum(b + n, last)]
        ended = n == most
        return np.where(ended, (length_a < length_b) | ((length_a == length_b) & or_equal), x < y)


def sort_suffixes(hashes: PrefixHash, begin: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes within their groups, which are contiguous and stay in place.

    Bottom-up mergesort: the place of a suffix in the merged run is its place in
    its own run plus its rank in the other, found by binary search. If hashes
    collide, suffixes can be out of order or missing, which the caller has to rule out.
    """
    n = len(begin)
    order = np.arange(n)
    if not n:
        return order
    first = np.concatenate([[True], group[1:] != group[:-1]])
    base = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    size = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1]
    place = np.arange(n) - base
    width = 1
    while width < size.max():
        run = place // width
        sibling = run ^ 1
        low = base + np.minimum(sibling * width, size)
        high = base + np.minimum((sibling + 1) * width, size)
        start = low.copy()
        is_left = run % 2 == 0
        work = np.flatnonzero(low < high)
        while len(work):
            mid = (low[work] + high[work]) >> 1
            other, own = order[mid], order[work]
            # A suffix of the right run goes after equal ones of the left run.
            before = hashes.less(begin[other], length[other], begin[own], length[own], ~is_left[work])
            low[work] = np.where(before, mid + 1, low[work])
            high[work] = np.where(before, high[work], mid)
            work = work[low[work] < high[work]]
        target = base + (run // 2) * 2 * width + (place - run * width) + (low - start)
        moved = order.copy()
        moved[target] = order
        order = moved
        width *= 2
    return order


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the substrings at a and b are equal byte by byte: rules out collisions of the hash."""
    out = np.ones(len(a), bool)
    step = 1 << 14
    for at in range(0, len(a), step):
        n = length[at : at + step]
        if not n.sum():
            continue
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        same = data[np.repeat(a[at : at + step], n) + inner] == data[np.repeat(b[at : at + step], n) + inner]
        owner = np.repeat(np.arange(len(n)), n)
        out[at : at + step] = np.bincount(owner, ~same, len(n)) == 0
    return out
