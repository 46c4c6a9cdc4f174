"""Order MinHash: sketches that are sensitive to edit similarity, and the alignment that verifies them."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import xxhash

from catalith.llm.decontaminate import words_of
from catalith.llm.rolling import Prefix, mix

U = np.uint64
#: Words in a shingle, sketches of a text, and k-mers in a sketch.
SHINGLE, SKETCHES, KMERS = 5, 32, 5
_ODD = np.random.default_rng(5).integers(1 << 62, 1 << 63, 256, dtype=U) | U(1)


def word_hashes(text: str | None) -> np.ndarray:
    """32 bits for each word: lower case, without marks."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) & 0xFFFFFFFF for w in words_of(text)), np.uint32)


def labelled(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The shingles in text order, each labelled with how often it has stood
    before; so no value repeats.  A text of fewer words is one shingle."""
    n = min(shingle, len(words))
    if not n:
        return np.empty(0, U)
    base = Prefix(words.astype(U) + U(1)).fixed(n)
    order = np.argsort(base, kind="stable")
    same = base[order]
    head = np.searchsorted(same, same, "left")
    times = np.empty(len(base), U)
    times[order] = (np.arange(len(base)) - head).astype(U)
    return mix(base ^ times * U(0x9E3779B97F4A7C15))


def sketch(labels: np.ndarray, sketches: int = SKETCHES, kmers: int = KMERS) -> np.ndarray:
    """One key for each of several random orders: its least labelled shingles, kept in text order."""
    n = len(labels)
    if not n:
        return np.empty(0, U)
    if n > kmers:
        at = np.empty((sketches, kmers), np.int64)
        step = max(1, (1 << 19) // n)
        for i in range(0, sketches, step):
            at[i : i + step] = np.argpartition(labels * _ODD[i : min(i + step, sketches), None], kmers - 1, axis=1)[:, :kmers]
        at.sort(axis=1)
    else:
        at = np.tile(np.arange(n), (sketches, 1))
    key = np.arange(1, sketches + 1, dtype=U)
    for i in range(at.shape[1]):
        key = mix(key * U(0xC2B2AE3D27D4EB4F) + labels[at[:, i]])
    return key


def aligned(a: np.ndarray, b: np.ndarray, order_a: np.ndarray, least: float) -> int:
    """Shingles that a banded alignment of two texts matches.  A similarity of
    ``least`` leaves at most (1 - least) / (1 + least) of the shingles unmatched,
    so no match can lie farther from the diagonal."""
    at = np.searchsorted(a, b, sorter=order_a)
    at[at == len(a)] = 0
    at = order_a[at]
    j = np.flatnonzero(a[at] == b)
    i = at[j]
    band = int((1 - least) / (1 + least) * (len(a) + len(b))) + 1
    i = i[np.abs(i - j) <= band]
    if (i[1:] > i[:-1]).all():
        return len(i)
    ends: list[int] = []
    for x in i.tolist():
        k = bisect_left(ends, x)
        if k == len(ends):
            ends.append(x)
        else:
            ends[k] = x
    return len(ends)


def similarity(a: np.ndarray, b: np.ndarray, order_a: np.ndarray, least: float) -> float:
    """Aligned shingles over all shingles of both; 0 where the sizes rule out ``least``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    same = aligned(a, b, order_a, least)
    return same / (len(a) + len(b) - same)
