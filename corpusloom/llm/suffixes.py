"""Suffix sorting by a difference cover modulo 3, in numpy, to a bounded depth.

Suffixes at positions that are not multiples of 3 are named by their first three symbols;
where names repeat, the string of names is sorted in the same way. Each level triples the
symbols that a name stands for, so a bounded depth needs few levels. The remaining suffixes
are sorted by their first symbol and the rank of the next suffix, and merged.
"""

from __future__ import annotations

import numpy as np

_BITS = np.uint64(21)
MOST = 1 << 21


def _packed(first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Tuples of values below 2 ** 21 as one sortable number."""
    out = first.view(np.uint64)
    for p in more:
        out = (out << _BITS) | p.view(np.uint64)
    return out


def _places(sorted_values: np.ndarray) -> np.ndarray:
    """For each value of a sorted array, how many are smaller."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.nonzero(new)[0][np.cumsum(new) - 1]


def ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix, from 1. Suffixes that agree in `depth` symbols may tie.

    Symbols are from 1 to 2 ** 21 - 3; after the end come zeros. At most so many symbols.
    """
    n = len(symbols)
    if n >= MOST - 3 or (n and int(symbols.max()) >= MOST - 3):
        raise ValueError("too many symbols for one sort")
    return _sorted(np.asarray(symbols, np.int64), depth)[0] if n else np.zeros(0, np.int64)


def _sorted(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of every suffix, suffixes in order)."""
    n = len(symbols)
    s = np.zeros(n + 4, np.int64)
    s[:n] = symbols
    at1, at2 = np.arange(1, n + 1, 3), np.arange(2, n + 1, 3)
    sample = np.concatenate([at1, at2])
    key = _packed(s[sample], s[sample + 1], s[sample + 2])
    order = np.argsort(key)
    smaller = _places(key[order])
    names = np.empty(len(sample), np.int64)
    names[order] = smaller + 1
    if depth > 3 and len(sample) and bool((smaller[1:] == smaller[:-1]).any()):
        # A one keeps the two halves of the sample apart.
        halves = np.concatenate([names[:len(at1)] + 1, [1], names[len(at1):] + 1])
        names, order = _sorted(halves, -(-depth // 3))
        names = np.delete(names, len(at1))
        order = order[order != len(at1)]
        order = order - (order > len(at1))
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    rank[n:] = 0
    sampled = sample[order]
    sampled = sampled[sampled < n]
    part = sampled % 3
    at1, at2 = sampled[part == 1], sampled[part == 2]

    at0 = np.arange(0, n, 3)
    key0 = _packed(s[at0], rank[at0 + 1])
    order0 = np.argsort(key0)
    at0, key0 = at0[order0], key0[order0]
    # Comparable pairs: the next suffix, or the one after, is ranked for both.
    key1 = _packed(s[at1], rank[at1 + 1])
    key02, key2 = (_packed(s[a], s[a + 1], rank[a + 2]) for a in (at0, at2))
    out = np.zeros(n, np.int64)
    out[sampled] = _places(rank[sampled]) + 1
    out[at1] += np.searchsorted(key0, key1)
    out[at2] += np.searchsorted(np.maximum.accumulate(key02), key2)
    out[at0] = _places(key0) + np.searchsorted(key1, key0) + np.searchsorted(np.maximum.accumulate(key2), key02) + 1
    return out, np.argsort(out)
