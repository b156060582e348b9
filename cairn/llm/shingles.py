"""Word shingles as 64-bit hashes, vectorised over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes of text hashed at once; a longer text is hashed alone.
CHUNK = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
with np.errstate(over="ignore"):
    _POWER = np.cumprod(np.full(1 << 16, 0x5851F42D4C957F2D, np.uint64))
#: A-Z fold to a-z; letters, digits and all bytes from 0x80 on belong to words.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _chunks(texts) -> Iterator[tuple[list[int], list[bytes]]]:
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        if rows and size + len(data) > CHUNK:
            yield rows, parts
            rows, parts, size = [], [], 0
        rows.append(row)
        parts.append(data)
        size += len(data) + 1
    if rows:
        yield rows, parts


def shingles(texts, words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of (row, shingle hash, count), sorted by row and hash.

    A text of fewer words than ``words``, but not none, has one shingle of all its words.
    """
    for rows, parts in _chunks(texts):
        data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        inside = np.concatenate([[False], _IN_WORD[data]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            continue
        with np.errstate(over="ignore"):
            at = np.arange(len(data)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(data)]]))) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(data)]])))])
            value = np.where(inside[1:], _BYTE[_FOLD[data]] * _POWER[at & 0xFFFF], _U(0))
            word = mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))
            limits = np.cumsum([len(p) + 1 for p in parts])
            doc = np.searchsorted(limits, starts, side="right")
            n = np.bincount(doc, minlength=len(parts))
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            place = np.arange(len(word)) - first[doc]
            size = np.minimum(n, words)
            keep = np.flatnonzero(place <= n[doc] - size[doc])
            total = np.zeros(len(keep), np.uint64)
            for j in range(words):
                used = j < size[doc[keep]]
                nxt = word[np.minimum(keep + j, len(word) - 1)]
                total = np.where(used, mix(total * _U(0x9E3779B97F4A7C15) + nxt), total)
        doc = doc[keep]
        order = np.lexsort((total, doc))
        doc, total = doc[order], total[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])])
        at = np.flatnonzero(new)
        yield np.asarray(rows)[doc[at]], total[at], np.diff(np.concatenate([at, [len(doc)]]))
