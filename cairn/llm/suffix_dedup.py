"""Removal of repeated byte strings by suffix sorting with a difference cover.

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a smaller id is removed.  A
full suffix array of the corpus would sort several times its size, so suffixes are first dealt to tasks in a way
that keeps equal ``LENGTH``-byte prefixes together, and only those that can repeat are sorted at all:

1. Equal texts become one unit with its smallest id; the other documents of a unit are repeated whole.
2. In every window of ``LENGTH`` bytes the ``GRAM``-byte string of least hash is the window's anchor, so equal
   windows have equal anchors.  Anchors are dealt by hash; those met in one document only are dropped, and with
   them all windows that they stand for.  Within a batch, an anchor met in more than two places is sent on as its
   first and last document, which decide the question, and kept locally otherwise.
3. Around each remaining anchor the bytes that its windows can reach (its context) are dealt by the anchor.
   Equal contexts of a batch are sent once.  In a task, an anchor with one distinct context is settled; the
   contexts of the others are joined to a text, whose suffixes are sorted by the distributed step of the
   difference-cover method: sampled triples are sorted and named, the names are sorted recursively, the remaining
   suffixes are merged in, and adjacent prefixes are compared.  Each run of equal ``LENGTH``-byte prefixes gives
   the smallest document of its windows, and every larger document loses them.
4. The removed runs of a unit are gathered, merged and applied.

Frequent anchors, such as those at the ends of a passage that many documents share, have about as many distinct
contexts as documents, which must not meet in one task.  A sample of the texts names them (it steers the dealing,
not the result); each window around them is dealt by its own hash and sent as its bytes, and equal windows of a batch
are sent once, so a passage of any number of documents costs one window a batch.  Hashes only deal and sort: what
counts as equal has been compared byte by byte (equal texts by SHA-256).  An anchor that the sample missed and whose
distinct contexts exceed one text is compared column by column (the windows at one distance from it, sorted by hash
and verified byte by byte), which needs memory for its contexts only.

Scale.  The list of frequent anchors has at most ``HOT_MOST`` of them.  Text is exchanged once, by text key, and that exchange is read by all three steps; anchors cost about ten
bytes for every sixteen of text, contexts exist for repeated anchors only.  The number of buckets follows the
bytes of the table (``BUCKET_BYTES`` of text each), so a bucket holds a bounded number of anchors; frequent
anchors and contexts are combined before they are sent.

Defined results: null text is the empty text (nothing to remove); a null id counts as larger than all others;
rows of equal id never remove from each other; repeated rows get equal results; texts shorter than ``LENGTH``
lose nothing; strings may start and end within a character; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import checkpoint, table, text_or_empty
from cairn.llm.difference_cover import equal_prefixes, suffix_array
from cairn.llm.shingles import mix

LENGTH = 50
GRAM = 20
#: Texts whose key, in hex, starts below this are sampled for frequent anchors: those of at least so many sampled texts, and
#: of at least this share of them.
HOT_SAMPLE, HOT_LEAST, HOT_SHARE, HOT_MOST = "04", 16, 0.001, 1 << 16
#: Bytes of text whose anchors share a bucket on average, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 32 << 20, 24
#: Contexts are dealt to so many times more buckets.
FINER = 3
#: Bytes of text worked on at once, and bytes of contexts sorted at once.
BATCH_BYTES, SORT_BYTES = 4 << 20, 1 << 20
#: Places in a piece of text whose windows are compared at once take this many bits of a 64-bit key.
_SEGMENT_BITS = 24
_BACK = LENGTH - GRAM
_WIDE = _BACK + LENGTH
#: No byte of UTF-8: fills contexts beyond the ends of a text.
_PAD = 0xFF
NO_ID = (1 << 63) - 1

_U = np.uint64
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
with np.errstate(over="ignore"):
    _FACTOR = np.cumprod(np.full(_WIDE, 0x5851F42D4C957F2D, np.uint64))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes that start at each byte but the last GRAM - 1."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        # Horner's rule by doubling: two halves of one length make the next.
        part, size, out, done = _VALUE[data], 1, None, 0
        left = GRAM
        while left:
            if left & 1:
                shifted = part[done : done + n]
                out = shifted if out is None else out * _power(size) + shifted
                done += size
            left >>= 1
            if left:
                part = part[: len(part) - size] * _power(size) + part[size:]
                size *= 2
        return mix(out)


def _power(n: int) -> np.uint64:
    return _U(pow(0x5851F42D4C957F2D, n, 1 << 64))


_INVERSE = np.array([pow(0x5851F42D4C957F2D, -j, 1 << 64) for j in range(_BACK + 1)], np.uint64)


def _window_hashes(context: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the LENGTH bytes from each of the first starts of each context."""
    with np.errstate(over="ignore"):
        sums = np.zeros((len(context), _WIDE + 1), np.uint64)
        np.cumsum(_VALUE[context] * _FACTOR[None, :], axis=1, out=sums[:, 1:])
        return mix((sums[:, LENGTH : LENGTH + _BACK + 1] - sums[:, : _BACK + 1]) * _INVERSE[None, :])


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of a byte matrix."""
    out = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows.shape[1]):
            out += _VALUE[rows[:, j]] * _FACTOR[j]
    return mix(out)


def _least_in_window(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` neighbours from each place on, by doubling."""
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - size : width - size + len(x) - width + 1]) if size < width else out


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the texts data[start:end], as (place in ``data``, hash), by place.

    Of equal hashes (of their upper 40 bits) in a window the first is the anchor, so that equal windows have it at
    the same place.
    """
    # 1 where a window that lies within one text starts.
    edge = np.zeros(len(data) + 1, np.int32)
    long_ = ends - starts >= LENGTH
    np.add.at(edge, starts[long_], 1)
    np.add.at(edge, ends[long_] - LENGTH + 1, -1)
    valid = np.cumsum(edge) > 0
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    low = _U((1 << _SEGMENT_BITS) - 1)
    for at in range(0, len(data) - LENGTH + 1, 1 << (_SEGMENT_BITS - 1)):
        piece = data[at : at + (1 << (_SEGMENT_BITS - 1)) + LENGTH - 1]
        h = _gram_hashes(piece)
        least = _least_in_window((h & ~low) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1)
        found = (least[valid[at : at + len(least)]] & low).astype(np.int64)
        found = found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found
        places.append(found + at)
        hashes.append(h[found])
    place, h = np.concatenate(places), np.concatenate(hashes)
    new = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
    return place[new], h[new]


class _Texts:
    """Some rows of an Arrow batch: their bytes without gaps, and columns."""

    def __init__(self, batch: pa.RecordBatch, lo: int, hi: int):
        text = batch.column("text")
        wide = pa.types.is_large_binary(text.type)
        offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32, len(text) + 1 + text.offset)[text.offset :].astype(np.int64)
        body = text.buffers()[2]
        self.data = np.frombuffer(body, np.uint8)[offsets[lo] : offsets[hi]] if body is not None else np.zeros(0, np.uint8)
        self.starts, self.ends = offsets[lo:hi] - offsets[lo], offsets[lo + 1 : hi + 1] - offsets[lo]
        self.lo, self.hi = lo, hi

    @staticmethod
    def of(batch: pa.RecordBatch) -> Iterator[_Texts]:
        text, lo, size = batch.column("text"), 0, 0
        lengths = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_binary(text.type) else np.int32, len(text) + 1 + text.offset)[text.offset :]
        for i, n in enumerate(np.diff(lengths)):
            if i > lo and size + n > BATCH_BYTES:
                yield _Texts(batch, lo, i)
                lo, size = i, 0
            size += int(n)
        if len(text) > lo:
            yield _Texts(batch, lo, len(text))


def _column(batch: pa.RecordBatch, name: str, lo: int, hi: int) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)[lo:hi].astype(np.int64)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _bytes(*arrays: np.ndarray) -> list[bytes]:
    return [a.tobytes() for a in arrays]


def _planes(x: np.ndarray) -> bytes:
    """Places byte by byte, lowest first, so that the high bytes, mostly zero, compress to nothing."""
    return np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _per_unit(unit: np.ndarray, ident: np.ndarray, row: np.ndarray) -> list[bytes]:
    """Of entries sorted by row: their units, those units' ids, and how many entries each has."""
    mine, n = np.unique(row, return_counts=True)
    return _bytes(unit[mine], ident[mine], n.astype(np.uint32))


def _entries(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit, id and place of each entry of a row."""
    n = np.frombuffer(r["n"], np.uint32)
    return np.repeat(np.frombuffer(r["units"], np.int64), n), np.repeat(np.frombuffer(r["ids"], np.int64), n), _from_planes(r["place"])


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the start of each group, and the group of each key."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


#: Anchors of a batch in one bucket.  known: met in two documents already; hash: 4 bytes each, if not known
#: (with the bucket some 37 bits: one in some 2,000 kept anchors of a bucket isn't repeated, which costs its context).
ANCHORS = pa.schema([("bucket", pa.int64()), ("known", pa.bool_()), ("units", pa.binary()), ("ids", pa.binary()), ("n", pa.binary()), ("place", pa.binary()), ("hash", pa.binary())])
ANCHORS_DDL = "bucket long, known boolean, units binary, ids binary, n binary, place binary, hash binary"
#: Places of repeated anchors in a unit.
PLACES = pa.schema([("unit", pa.int64()), ("places", pa.binary())])
#: Of a batch in one bucket: contexts, runs to be removed, or windows.
AS_CONTEXTS, AS_RUNS, AS_WINDOWS = 0, 1, 2
CONTEXTS = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("units", pa.binary()), ("ids", pa.binary()), ("n", pa.binary()), ("place", pa.binary()), ("context", pa.binary())])
CONTEXTS_DDL = "bucket long, kind int, units binary, ids binary, n binary, place binary, context binary"
#: Runs of removed bytes in a unit: starts and ends, alternating.
RUNS = pa.schema([("unit", pa.int64()), ("runs", pa.binary())])


def _find_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in _Texts.of(batch):
                unit, ident = _column(batch, "unit", t.lo, t.hi), _column(batch, "id", t.lo, t.hi)
                place, h = anchors(t.data, t.starts, t.ends)
                if not len(place):
                    continue
                row = np.searchsorted(t.ends, place, side="right")
                order = np.lexsort((ident[row], h))
                place, h, row = place[order], h[order], row[order]
                start, group = _groups(h)
                stop = np.append(start[1:], len(h))
                among = ident[row]
                several = among[start] < among[stop - 1]
                at = np.arange(len(h))
                known = several[group] & (at != start[group]) & (at != stop[group] - 1)
                bucket = np.where(known, unit[row] % buckets, (h % _U(buckets)).astype(np.int64))
                tail = h // _U(buckets)
                order = np.lexsort((row, bucket, known))
                rows = []
                for s, e in _cuts(known[order], bucket[order]):
                    o = order[s:e]
                    four = b"" if known[o[0]] else tail[o].astype(np.uint32).tobytes()
                    rows.append((int(bucket[o[0]]), bool(known[o[0]]), *_per_unit(unit, ident, row[o]), _planes(place[o] - t.starts[row[o]]), four))
                yield _batch(ANCHORS, rows)

    return run


def _cuts(*keys: np.ndarray) -> list[tuple[int, int]]:
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    s = np.flatnonzero(new)
    return list(zip(s.tolist(), [*s[1:].tolist(), len(new)], strict=True))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of batches sorted by bucket, a bucket at a time."""
    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != now and rows:
                yield now, rows
                rows = []
            now = r["bucket"]
            rows.append(r)
    if rows:
        yield now, rows


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _by_bucket(batches):
        units, ids, places, hashes, known = [], [], [], [], []
        for r in rows:
            unit, ident, place = _entries(r)
            if r["known"]:
                known.append((unit, place))
                continue
            units.append(unit)
            ids.append(ident)
            places.append(place)
            hashes.append(np.frombuffer(r["hash"], np.uint32))
        unit, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (units, places))
        if hashes:
            ident, h = np.concatenate(ids), np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            start, group = _groups(h[order])
            among = ident[order]
            kept = order[(np.minimum.reduceat(among, start) < np.maximum.reduceat(among, start))[group]]
            unit, place = unit[kept], place[kept]
        unit = np.concatenate([unit, *[u for u, _ in known]])
        place = np.concatenate([place, *[p for _, p in known]]).astype(np.uint32)
        if len(unit):
            order = np.argsort(unit, kind="stable")
            unit, place = unit[order], place[order]
            yield _batch(PLACES, [(int(unit[s]), place[s:e].tobytes()) for s, e in _cuts(unit)])


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching intervals as maximal ones."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


def _run_rows(unit: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple]:
    order = np.argsort(unit, kind="stable")
    unit, starts, ends = unit[order], starts[order], ends[order]
    out = []
    for s, e in _cuts(unit) if len(unit) else []:
        a, b = _merge(starts[s:e], ends[s:e])
        out.append((int(unit[s]), np.stack([a, b], axis=1).astype(np.int64).tobytes()))
    return out


def _equal(order: np.ndarray, new: np.ndarray, rows, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places ordered by hash and ``extra``, ``new`` where the hash changes: an order in which equal rows are
    neighbours, and where groups of them start.

    Rows of equal hash are compared byte by byte (``rows`` gives the bytes of places); should some differ, their bytes
    take part in the order.
    """
    clash = np.zeros(len(order), bool)
    for s in range(1, len(order), 1 << 15):
        same = s + np.flatnonzero(~new[s : s + (1 << 15)])
        clash[same] = (rows(order[same]) != rows(order[same - 1])).any(axis=1)
    if clash.any():
        group = np.cumsum(new) - 1
        for g in np.unique(group[clash]).tolist():
            mine = np.flatnonzero(group == g)
            ranked = sorted((rows(order[k : k + 1]).tobytes(), int(extra[order[k]]), int(order[k])) for k in mine)
            order[mine] = [x for _, _, x in ranked]
            new[mine] = [k == 0 or ranked[k][0] != ranked[k - 1][0] for k in range(len(ranked))]
    return order, new


def _equal_rows(first: np.ndarray, rows: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (first, row, extra), and whether each place starts a group of equal (first, row)."""
    h = _row_hashes(rows)
    order = np.lexsort((extra, h, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order[1:]] != first[order[:-1]]) | (h[order[1:]] != h[order[:-1]])
    return _equal(order, new, lambda i: rows[i], extra)


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a batch each anchor is."""
    for batch in batches:
        for t in _Texts.of(batch):
            place, h = anchors(t.data, t.starts, t.ends)
            row = np.searchsorted(t.ends, place, side="right")
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
            h, n = np.unique(h[first], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])


def frequent_anchors(texts: DataFrame) -> np.ndarray:
    """Hashes of the anchors that are frequent in a sample of ``texts`` (key, text), sorted."""
    sample = texts.where(F.substring(F.hex("key"), 1, len(HOT_SAMPLE)) < HOT_SAMPLE)
    counts = sample.select("text").mapInArrow(_count_anchors, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    least = max(HOT_LEAST, int(HOT_SHARE * sample.count()))
    rows = counts.where(F.col("n") >= least).orderBy(F.col("n").desc(), "hash").limit(HOT_MOST).select("hash").collect()
    return np.sort(np.array([r["hash"] for r in rows], np.int64).view(np.uint64))


def _hot_windows(context, unit, ident, place, row, buckets: int) -> list[tuple]:
    """Windows around frequent anchors: of equal ones those of the smallest document are sent on, dealt by their hash,
    and those of others are settled."""
    first = _window_hashes(context)
    inside = context != _PAD
    lo, hi = inside.argmax(axis=1), _WIDE - inside[:, ::-1].argmax(axis=1)
    offset = np.arange(_BACK + 1)
    r, o = np.nonzero((offset[None, :] >= lo[:, None]) & (offset[None, :] + LENGTH <= hi[:, None]))
    if not len(r):
        return []
    start, row = place[r] - _BACK + o, row[r]
    # A window around two frequent anchors is one window.
    once = np.unique((row.astype(np.int64) << 32) | start, return_index=True)[1]
    h, at, start, row = first[r, o][once], (r[once], o[once]), start[once], row[once]
    who, windows = ident[row], np.lib.stride_tricks.sliding_window_view(context, LENGTH, axis=1)
    order = np.lexsort((who, h))
    new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
    order, new = _equal(order, new, lambda i: windows[at[0][i], at[1][i]], who)
    h, who, start, row, at = h[order], who[order], start[order], row[order], (at[0][order], at[1][order])
    least = who[np.flatnonzero(new)][np.cumsum(new) - 1]
    settled = who > least
    target = np.where(settled, unit[row] % buckets, (h % _U(buckets)).astype(np.int64))
    by = np.lexsort((start, row, target, settled))
    out = []
    for s, e in _cuts(settled[by], target[by]):
        i = by[s:e]
        if settled[i[0]]:
            # Neighbouring windows of one document as one run.
            head = np.flatnonzero(np.concatenate([[True], (row[i][1:] != row[i][:-1]) | (start[i][1:] > start[i][:-1] + LENGTH)]))
            tail = np.append(head[1:], len(i)) - 1
            out.append((int(target[i[0]]), AS_RUNS, *_per_unit(unit, ident, row[i[head]]), _planes(start[i[head]]), _planes(start[i[tail]] + LENGTH)))
        else:
            out.append((int(target[i[0]]), AS_WINDOWS, *_per_unit(unit, ident, row[i]), _planes(start[i]), windows[at[0][i], at[1][i]].tobytes()))
    return out


def _find_contexts(buckets: int, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = held.value
        for batch in batches:
            lists = batch.column("places")
            for t in _Texts.of(batch):
                unit, ident = _column(batch, "unit", t.lo, t.hi), _column(batch, "id", t.lo, t.hi)
                place = [np.unique(np.frombuffer(b"".join(x.as_py() for x in lists[i].values), np.uint32)) for i in range(t.lo, t.hi)]
                row = np.repeat(np.arange(len(place)), [len(p) for p in place])
                place = np.concatenate(place).astype(np.int64)
                if not len(place):
                    continue
                # Each text between pads, so that contexts never reach the next one.
                padded = np.full(len(t.data) + (len(t.starts) + 1) * _WIDE, _PAD, np.uint8)
                shift = (np.arange(len(t.starts)) + 1) * _WIDE
                lengths = t.ends - t.starts
                padded[np.arange(len(t.data)) + np.repeat(shift, lengths)] = t.data
                at = place + t.starts[row] + shift[row] - _BACK
                context = np.lib.stride_tricks.sliding_window_view(padded, _WIDE)[at]
                out: list[tuple] = []
                if len(hot):
                    gram = _gram_hashes(np.ascontiguousarray(context[:, _BACK : _BACK + GRAM]).ravel())[::GRAM]
                    frequent = hot[np.minimum(np.searchsorted(hot, gram), len(hot) - 1)] == gram
                    if frequent.any():
                        out += _hot_windows(context[frequent], unit, ident, place[frequent], row[frequent], buckets)
                        context, place, row = context[~frequent], place[~frequent], row[~frequent]
                if not len(place):
                    yield _batch(CONTEXTS, out)
                    continue
                order, new = _equal_rows(np.zeros(len(place), np.int64), context, ident[row])
                group = np.cumsum(new) - 1
                least = ident[row[order[np.flatnonzero(new)]]]
                settled = ident[row[order]] > least[group]
                target = np.where(settled, unit[row[order]] % buckets, (_row_hashes(context[order, _BACK : _BACK + GRAM]) % _U(buckets)).astype(np.int64))
                by = np.lexsort((row[order], target, settled))
                order, target, settled = order[by], target[by], settled[by]
                for s, e in _cuts(settled, target):
                    i = order[s:e]
                    if settled[s]:
                        # Only the runs are needed: their ends stand in the place of contexts.
                        starts, ends = np.maximum(place[i] - _BACK, 0), np.minimum(place[i] + LENGTH, lengths[row[i]])
                        out.append((int(target[s]), AS_RUNS, *_per_unit(unit, ident, row[i]), _planes(starts), _planes(ends)))
                    else:
                        out.append((int(target[s]), AS_CONTEXTS, *_per_unit(unit, ident, row[i]), _planes(place[i]), context[i].tobytes()))
                yield _batch(CONTEXTS, out)

    return run


def _least_sorted(context: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """For each context and each start in it, the smallest id that has the LENGTH bytes there (suffix sorting)."""
    n = len(context)
    text = np.full((n, _WIDE + 1), _PAD, np.uint8)
    text[:, :_WIDE] = context
    text = text.ravel()
    order = suffix_array(text)
    same = equal_prefixes(text, order, LENGTH)
    start = np.flatnonzero(~same)
    least = np.minimum.reduceat(ident[order // (_WIDE + 1)], start)[np.cumsum(~same) - 1]
    out = np.empty(len(text), np.int64)
    out[order] = least
    return out.reshape(n, _WIDE + 1)[:, : _BACK + 1]


def _least_by_column(context: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """The same for contexts around one anchor, whose equal windows lie at equal places."""
    out = np.empty((len(context), _BACK + 1), np.int64)
    for j in range(_BACK + 1):
        order, new = _equal_rows(np.zeros(len(context), np.int64), context[:, j : j + LENGTH], ident)
        out[order, j] = ident[order[np.flatnonzero(new)]][np.cumsum(new) - 1]
    return out


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _by_bucket(batches):
        runs, parts, windows = [], [], []
        for r in rows:
            unit, ident, place = _entries(r)
            if r["kind"] == AS_WINDOWS:
                windows.append((unit, ident, place.astype(np.int64), np.frombuffer(r["context"], np.uint8).reshape(-1, LENGTH)))
            elif r["kind"] == AS_RUNS:
                runs.append((unit, place.astype(np.int64), _from_planes(r["context"]).astype(np.int64)))
            else:
                parts.append((unit, ident, place.astype(np.int64), np.frombuffer(r["context"], np.uint8).reshape(-1, _WIDE)))
        if parts:
            unit, ident, place, context = (np.concatenate(x) for x in zip(*parts, strict=True))
            runs += _settled(unit, ident, place, context)
        if windows:
            unit, ident, place, window = (np.concatenate(x) for x in zip(*windows, strict=True))
            order, new = _equal_rows(np.zeros(len(unit), np.int64), window, ident)
            least = np.minimum.reduceat(ident[order], np.flatnonzero(new))[np.cumsum(new) - 1]
            gone = order[ident[order] > least]
            runs.append((unit[gone], place[gone], place[gone] + LENGTH))
        if runs:
            yield _batch(RUNS, _run_rows(*(np.concatenate(x) for x in zip(*runs, strict=True))))


def _settled(unit, ident, place, context):
    """Removed runs (unit, start, end) from all contexts of a bucket."""
    anchor = _row_hashes(context[:, _BACK : _BACK + GRAM])
    order, new = _equal_rows(anchor, context, ident)
    kind = np.empty(len(order), np.int64)  # the distinct context of each row
    kind[order] = np.cumsum(new) - 1
    first = order[np.flatnonzero(new)]  # its first row, of smallest id
    start, group = _groups(anchor[first])
    size = np.diff(np.append(start, len(first)))
    first_id, text = ident[first], context[first]
    inside = text != _PAD
    lo, hi = inside.argmax(axis=1), _WIDE - inside[:, ::-1].argmax(axis=1)
    alone = (size == 1)[group]
    out = []
    # The one context of an anchor: all its windows are the smallest document's.
    gone = alone[kind] & (first_id[kind] < ident) & (hi - lo >= LENGTH)[kind]
    if gone.any():
        begin = place[gone] - _BACK
        out.append((unit[gone], begin + lo[kind[gone]], begin + hi[kind[gone]]))

    # The others, as many anchors at once as one sorted text takes.
    row_of = np.argsort(kind, kind="stable")
    at_kind = np.searchsorted(kind[row_of], np.arange(len(first) + 1))
    most = SORT_BYTES // (_WIDE + 1)
    several = np.flatnonzero(size > 1)
    for g in several[size[several] > most].tolist():
        mine = np.arange(start[g], start[g] + size[g])
        out += _lost(mine, _least_by_column(text[mine], first_id[mine]), row_of, at_kind, unit, ident, place, lo, hi)
    several = several[size[several] <= most]
    # Half a text is filled before the next group may overfill it.
    part = (np.cumsum(size[several]) - size[several]) // max(1, most // 2)
    for s, e in _cuts(part) if len(part) else []:
        g = several[s:e]
        n = size[g]
        these = np.repeat(start[g] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out += _lost(these, _least_sorted(text[these], first_id[these]), row_of, at_kind, unit, ident, place, lo, hi)
    return out


def _lost(kinds, least, row_of, at_kind, unit, ident, place, lo, hi):
    """Runs of the windows around the given distinct contexts that a smaller document has as well."""
    n = np.diff(at_kind)[kinds]
    which = np.repeat(np.arange(len(kinds)), n)
    rows = row_of[np.repeat(at_kind[kinds] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    offset, out = np.arange(_BACK + 1), []
    for at in range(0, len(rows), 1 << 16):
        i, k = rows[at : at + (1 << 16)], which[at : at + (1 << 16)]
        c = kinds[k]
        whole = (offset[None, :] >= lo[c, None]) & (offset[None, :] + LENGTH <= hi[c, None])
        r, o = np.nonzero(whole & (least[k] < ident[i, None]))
        if len(r):
            begin = place[i[r]] - _BACK + o
            # Neighbouring windows of one row as one run.
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (begin[1:] > begin[:-1] + LENGTH)])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(r)) - 1
            out.append((unit[i[r[head]]], begin[head], begin[tail] + LENGTH))
    return out


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _apply(keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, copy, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "copy", "runs")), strict=True):
                n = len(text)
                if copy:
                    starts, ends = (np.array([0]), np.array([n])) if n >= LENGTH else (np.zeros(0, int), np.zeros(0, int))
                else:
                    pairs = np.frombuffer(b"".join(runs or []), np.int64).reshape(-1, 2)
                    starts, ends = _merge(pairs[:, 0], pairs[:, 1])
                kept, last = [], 0
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    kept.append(text[last:s])
                    last = e
                kept = b"".join([*kept, text[last:]])
                rows.append((doc, n, n - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            yield _batch(RESULT, rows)

    return run


def remove_repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs`` (doc_id, text).

    With ``keep_bytes`` the remaining bytes follow as ``kept``.
    """
    body = text_or_empty().cast("binary")
    docs = docs.select("doc_id", body.alias("text"), F.unhex(F.sha2(body, 256)).alias("key"))
    slim = docs.select("key", F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id"), F.octet_length("text").alias("n"))
    units = slim.groupBy("key").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    units = checkpoint(units.select(F.col("key").alias("k"), "id", "n", F.monotonically_increasing_id().alias("unit")))
    total = units.agg(F.sum("n")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))

    held = docs.sparkSession.sparkContext.broadcast(frequent_anchors(docs))

    id_ = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    # Not an equality of columns, which would join the keys: all three joins then read one exchange of the texts.
    is_first = id_.bitwiseXOR(F.col("id")) == 0
    joined = docs.join(units.select("k", "id", "unit"), F.col("key") == F.col("k"))
    first = joined.where(is_first).select("unit", "id", "text")
    dealt = first.mapInArrow(_find_anchors(buckets), ANCHORS_DDL).repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    places = dealt.mapInArrow(_repeated, "unit long, places binary").groupBy("unit").agg(F.collect_list("places").alias("places"))

    there = units.select("k", "id", "unit").join(places, "unit")
    again = docs.join(there, F.col("key") == F.col("k")).where(is_first).select("unit", "id", "text", "places")
    dealt = again.mapInArrow(_find_contexts(FINER * buckets, held), CONTEXTS_DDL).repartitionById(FINER * buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    runs = dealt.mapInArrow(_settle, "unit long, runs binary").groupBy("unit").agg(F.collect_list("runs").alias("runs"))

    there = units.select("k", "id", "unit").join(runs, "unit", "left").drop("unit")
    out = docs.join(there, F.col("key") == F.col("k")).select("doc_id", "text", (id_ != F.col("id")).alias("copy"), "runs")
    out = out.mapInArrow(_apply(keep_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_bytes else out.drop("kept")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract of op10 over all of ``documents``."""
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


# Texts are cut into pieces that overlap by a window, so that taking a window from a piece doesn't walk through the text.
OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT rid, doc_id, k, substr(x, k * 1024 + 1, 1024 + 98) AS y, least(1024, length(x) - k * 1024) AS own FROM (SELECT *, unnest(range(0, (length(x) + 1023) // 1024)) AS k FROM d)),
w AS (
  SELECT rid, doc_id, k * 512 + p AS i, CASE WHEN 2 * p + 100 <= length(y) THEN md5(substr(y, 2 * p + 1, 100)) END AS h
  FROM (SELECT *, unnest(range(0, own // 2)) AS p FROM c)),
m AS (SELECT h, min(doc_id) AS least FROM w WHERE h IS NOT NULL GROUP BY h),
r AS (SELECT w.rid, w.i FROM w JOIN m USING (h) WHERE m.least < coalesce(w.doc_id, 9223372036854775807)),
e AS (SELECT rid, i, coalesce(i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 50, true) AS opens FROM r),
s AS (SELECT rid, i, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY rid ORDER BY i) AS span FROM e),
g AS (SELECT rid, span, min(i) AS b, max(i) + 50 AS z FROM s GROUP BY ALL),
n AS (SELECT rid, CAST(sum(z - b) AS BIGINT) AS n_removed, count(*) AS n_spans, list(b ORDER BY b) AS bs, list(z ORDER BY b) AS zs FROM g GROUP BY rid),
k AS (
  SELECT d.doc_id, d.x, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
         list_transform(range(0, coalesce(n_spans, 0) + 1), lambda j: substr(x, CAST(2 * coalesce(zs[j], 0) + 1 AS BIGINT), CAST(2 * (coalesce(bs[j + 1], length(x) // 2) - coalesce(zs[j], 0)) AS BIGINT))) AS kept
  FROM d LEFT JOIN n USING (rid))
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(array_to_string(kept, ''))) AS kept_sha256
FROM k
"""
