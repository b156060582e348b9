"""DartMinHash signatures of weighted sets.

Every element owns the quarter plane of (weight, rank); it is cut into regions, and each region holds a number of
darts, their places and their coordinates of the signature, all drawn from hashes of the element and the region.
A set with weights w throws all darts that lie below w[element] and below a common rank limit; each coordinate of
the signature keeps the dart of lowest rank.  Two sets agree in a coordinate with probability equal to their
weighted Jaccard similarity (sum of minima over sum of maxima).  The rank limit falls with a set's total weight,
so a signature costs about ``K * ln(K)`` darts, whatever the size of the set; where a coordinate stays empty the
limit is doubled for that set.
"""

from __future__ import annotations

import numpy as np

from cairn.llm.shingles import mix

_U = np.uint64
FIRST_RANK = 0.25
#: A region is cut into pieces of at most this expected number of darts.
PIECE = 8.0


def _poisson(area: float, u: np.ndarray) -> np.ndarray:
    top = int(area + 12 * np.sqrt(area) + 20)
    terms = np.empty(top)
    terms[0] = np.exp(-area)
    for i in range(1, top):
        terms[i] = terms[i - 1] * area / i
    return np.searchsorted(np.cumsum(terms), u, side="right")


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * 2.0**-53


def _throw(row, element, weight, low, limit, k):
    """Darts with rank in [low[row], limit[row]) as (row, coordinate, rank, id)."""
    out = []
    top_w, top_r = float(weight.max()), float(limit.max())
    w0 = 0.0
    while w0 < top_w:
        w1 = max(1.0, 2 * w0)
        has = np.flatnonzero(weight > w0)
        r0 = 0.0
        while r0 < top_r:
            r1 = max(FIRST_RANK, 2 * r0)
            at = has[(limit[row[has]] > r0) & (low[row[has]] < r1)]
            if len(at):
                pieces = max(1, int(np.ceil((w1 - w0) * (r1 - r0) / PIECE)))
                step = (r1 - r0) / pieces
                with np.errstate(over="ignore"):
                    tag = _U(int(np.log2(w1) + 1) * 4096 + int(round(np.log2(r1 / FIRST_RANK))))
                    for p in range(pieces):
                        base = mix(element[at] + mix(np.array([(tag << _U(24)) + _U(p + 1)]))[0])
                        n = _poisson((w1 - w0) * step, _uniform(base))
                        which = np.repeat(at, n)
                        if not len(which):
                            continue
                        number = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                        dart = mix(np.repeat(base, n) + (number + 1).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
                        place = w0 + (w1 - w0) * _uniform(mix(dart + _U(1)))
                        second = mix(dart + _U(2))
                        rank = r0 + step * (p + _uniform(second))
                        good = (place < weight[which]) & (rank < limit[row[which]]) & (rank >= low[row[which]])
                        out.append((row[which[good]], (mix(dart[good] + _U(3)) % _U(k)).astype(np.int64), rank[good], dart[good]))
            r0 = r1
        w0 = w1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """An (n, k) array of dart ids; ``row`` is sorted and every row from 0 to n - 1 has an element."""
    total = np.bincount(row, weights=weight, minlength=n)
    low, limit = np.zeros(n), (k * np.log(k) + 2 * k) / total
    sig, best = np.zeros(n * k, np.uint64), np.full(n * k, np.inf)
    todo = np.ones(n, bool)
    while todo.any():
        used = todo[row]
        r, j, rank, dart = _throw(row[used], element[used], weight[used].astype(np.float64), low, limit, k)
        slot = r * k + j
        order = np.lexsort((rank, slot))
        slot, rank, dart = slot[order], rank[order], dart[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
        slot, rank, dart = slot[first], rank[first], dart[first]
        better = rank < best[slot]
        sig[slot[better]], best[slot[better]] = dart[better], rank[better]
        todo = np.isinf(best).reshape(n, k).any(axis=1)
        low = np.where(todo, limit, low)
        limit = np.where(todo, 2 * limit, 0.0)
    return sig.reshape(n, k)


def weighted_jaccard(a, b) -> float:
    """Of two (hashes, counts) pairs, each sorted by hash; 1 for two empty sets."""
    (x, m), (y, n) = a, b
    total = float(m.sum() + n.sum())
    if not total:
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[at] == x
    shared = float(np.minimum(m[same], n[at[same]]).sum())
    return shared / (total - shared)
