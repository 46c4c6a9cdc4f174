"""Vectorised window fingerprints over sequences of 64-bit units.

A *unit* is a word or a byte.  Two sequences of ``length`` units that are equal
have the same leftmost minimal ``k``-gram, the *anchor*, at the same offset, so
only windows whose anchors agree can be equal.  Each anchor position owns a
contiguous range of window starts; the units those windows span are its
*context*.  Equal contexts own equal windows.

All functions take several documents laid end to end: ``units`` holds the
units, ``bounds`` the ``n + 1`` document borders.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
CHUNK = 1 << 18


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            both = tuple(np.multiply.accumulate(np.concatenate(([U(1)], np.full(size - 1, b, U)))) for b in (base, inverse))
        _POWERS[base] = got = both
    return got[0][:n], got[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash so that all bits depend on all bits."""
    h = h ^ (h >> U(31))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(32)
    return h


class Prefix:
    """Prefix sums from which the hash of any range of units follows."""

    def __init__(self, units: np.ndarray, which: int = 0):
        n = len(units)
        power, self.inverse = _powers(_BASES[which], n + 1)
        self.sums = np.empty(n + 1, U)
        self.sums[0] = 0
        np.cumsum(units * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U))

    def fixed(self, size: int) -> np.ndarray:
        """Hashes of all ranges of ``size`` units."""
        if len(self.sums) <= size:
            return np.empty(0, U)
        return mix((self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size] + U(size))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least value in each window of ``width``."""
    at = np.arange(len(values), dtype=np.int64)
    span = 1
    while span < width:
        step = min(span, width - span)
        a, b = values[:-step], values[step:]
        left = a <= b
        values, at = np.where(left, a, b), np.where(left, at[:-step], at[step:])
        span += step
    return at


def anchors(units: np.ndarray, bounds: np.ndarray, length: int, k: int) -> dict[str, np.ndarray]:
    """One row for each anchor position of each document, in order: doc (index),
    anchor and context hashes, first/last window start that it owns, and its position."""
    empty = {n: np.empty(0, t) for n, t in (("doc", np.int64), ("anchor", U), ("context", U), ("first", np.int64), ("last", np.int64), ("at", np.int64))}
    if len(units) < length:
        return empty
    prefix = Prefix(units)
    at = sliding_argmin(prefix.fixed(k), length - k + 1)
    starts = np.arange(len(at), dtype=np.int64)
    doc = np.searchsorted(bounds, starts, "right") - 1
    inside = starts + length <= bounds[doc + 1]
    starts, at, doc = starts[inside], at[inside], doc[inside]
    if not len(starts):
        return empty
    new = np.empty(len(starts), bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    first, last = starts[head], starts[np.append(head[1:], len(starts)) - 1]
    at, doc = at[head], doc[head]
    context = prefix.of(first, last + length)
    context = mix(context ^ ((at - first).astype(U) * U(0xD6E8FEB86659FD93)))
    return {"doc": doc, "anchor": prefix.of(at, at + k), "context": context, "first": first, "last": last, "at": at}


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges first..last, and the range each is of."""
    sizes = last - first + 1
    of = np.repeat(np.arange(len(first)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[of], of


def cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n units lie in any of the ranges."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def as_key(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def batches(texts: list[bytes], limit: int = CHUNK):
    """Index ranges of consecutive texts whose sizes add up to about ``limit``."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)
