"""Suffix arrays by the difference cover modulo 3, vectorised."""

from __future__ import annotations

import numpy as np

#: Longest text for which three names fit one 63-bit key.
LONGEST = (1 << 21) - 8


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The order that sorts ``keys``, their names (equal keys share one, from 1), and the number of names."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.concatenate([[1], (ranked[1:] != ranked[:-1]).astype(np.int64)])
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(new)
    return order, names, int(new.sum())


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text`` (integers >= 0) in order; a suffix precedes its extensions."""
    n = len(text)
    if n > LONGEST:
        raise ValueError(f"text of {n} symbols; at most {LONGEST} fit one key")
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), dtype=np.int64)
    if (top := int(text.max())) > n:
        text, top = _names(text.astype(np.int64))[1], n
    s = np.concatenate([text.astype(np.int64) + 1, np.zeros(3, np.int64)])
    base = top + 2

    # Sort the triples that start at sampled positions (1 and 2 modulo 3) and name them.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    order, names, distinct = _names((s[sample] * base + s[sample + 1]) * base + s[sample + 2])
    if distinct < len(sample):
        # Recurse on the names: first those of 1 modulo 3, then those of 2 modulo 3.
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]

    # The remaining suffixes: one symbol and the rank of the sampled suffix behind it.
    zero = np.arange(0, n, 3)
    size = len(sample) + 2
    zero = zero[np.argsort(s[zero] * size + rank[zero + 1], kind="stable")]

    # Merge: against 1 modulo 3 one symbol and a rank decide, against 2 modulo 3 two symbols and a rank.
    ones, twos = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    below_one = np.searchsorted(s[ones] * size + rank[ones + 1], s[zero] * size + rank[zero + 1])
    pair = lambda i: (s[i] * base + s[i + 1]) * size + rank[i + 2]
    below_two = np.searchsorted(pair(twos), pair(zero))
    out = np.empty(n, np.int64)
    place = np.arange(len(zero)) + below_one + below_two
    out[place] = zero
    free = np.ones(n, bool)
    free[place] = False
    out[free] = sorted_sample
    return out


def equal_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix of ``order`` whether its first ``length`` symbols equal those of the suffix before it.

    Suffixes shorter than ``length`` equal nothing.
    """
    same = np.zeros(len(order), bool)
    views = np.lib.stride_tricks.sliding_window_view(text, length) if len(text) >= length else None
    if views is None:
        return same
    for at in range(1, len(order), 1 << 16):
        here, before = order[at : at + (1 << 16)], order[at - 1 : at - 1 + min(1 << 16, len(order) - at)]
        whole = np.flatnonzero((here + length <= len(text)) & (before + length <= len(text)))
        same[at + whole] = (views[here[whole]] == views[before[whole]]).all(axis=1)
    return same
