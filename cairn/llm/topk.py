"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

All vectors are rotated by the eigenvectors of their second-moment matrix (the right singular vectors of the
table), so that a few leading coordinates carry most of every inner product.  The ``SEEDS`` longest vectors give each
query a lower bound of its k-th score, and so the length that a candidate must have to be of use to it (its reach).
Queries of like reach share a block; a block of candidates is sent only to the query blocks whose reach its longest
vector has.  A task holds one block of queries and streams blocks of candidates in descending length.  A query is
finished when its length times the longest remaining length can't reach its k-th score; for the others the leading
coordinates are multiplied first, and only pairs whose partial sum plus the product of the residual lengths can reach
the k-th score get the exact integer product.  Bounds are compared with a margin, scores are exact.

Scale.  The queries are a stated set, in blocks of ``QUERY_BYTES``, and what bounds can't exclude is multiplied: a
candidate of 256 bytes that is sent meets some 8,000 queries, a million operations, so arithmetic rather than the
exchange sets the pace.  Equal lengths are told apart by a hash, so that they spread over all ranges.  The candidates
of a query block are dealt to ``slices`` tasks, and the k best of each slice are merged by a partial aggregation
bounded by k rows a slice.  A task's memory is one query block, one candidate block and ``ROWS_AT_ONCE`` rows of their
products.  The driver receives a d x d matrix, summed in two levels, the seeds, and two numbers a query block.

Defined results: vectors that are null or hold a null or non-finite component, and rows without an id, take no
part; shorter vectors count as padded with zeros; products that float64 may round are taken in wide integers, and
scores beyond a BIGINT, on which the SQL fails, count as its bounds; every row is a query or candidate of its own,
also where rows repeat or share an id, and only the query's own row is no candidate; empty vectors score 0; ties go to
the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import checkpoint, table

SCALE = 64
K = 20
QUERY_EVERY = 20
#: Bytes of a block's vectors, queries and candidates compared at once, and longest vectors that give the first bounds.
QUERY_BYTES, CANDIDATE_BYTES = 4 << 20, 1 << 20
ROWS_AT_ONCE = 512
SEEDS = 2048
HEAD_SHARE = 0.25
#: Sums of products below this size are exact in float64; scores end at ``MOST``.
EXACT = 2.0**52
MOST = (1 << 63) - 1
#: Vectors whose components all stay below this size are held as int32; it also bounds a vector's say in the rotation.
LIMIT = 1 << 22


def _quantise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, vecs, sizes, norms = [], [], [], []
        for i, v in zip(batch["vec_id"], batch["embedding"], strict=True):
            if v is None or i is None or i != i:
                continue
            x = np.array([np.nan if y is None else y for y in v], dtype=np.float64)
            if np.isfinite(x).all():
                most = np.finfo(np.float64).max / SCALE
                q = np.floor(np.clip(x, -most, most) * SCALE) + 0.0
                size = max(1.0, float(np.abs(q).max(initial=0)))
                ids.append(int(i))
                vecs.append(q.astype(np.int32).tobytes() if size <= LIMIT else q.tobytes() + WIDE)
                sizes.append(len(q))
                norms.append(min(float(np.sqrt(((q / size) ** 2).sum())) * size, np.finfo(np.float64).max))
        yield pd.DataFrame({"vec_id": ids, "vec": vecs, "size": sizes, "norm": norms}).astype({"vec_id": "int64", "vec": object, "size": "int32", "norm": "float64"})


#: Ends the bytes of a vector held as float64.
WIDE = b"w"


def _components(v: bytes) -> np.ndarray:
    return np.frombuffer(v, np.int32) if len(v) % 4 == 0 else np.frombuffer(v[:-1], np.float64)


def _matrix(vecs, d: int) -> np.ndarray:
    out = np.zeros((len(vecs), d))
    for i, v in enumerate(vecs):
        x = _components(v)
        out[i, : len(x)] = x
    return out


def _rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Orthonormal columns, of largest second moment first."""

    def moment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                x = np.clip(_matrix(batch["vec"].iloc[at : at + ROWS_AT_ONCE], d), -LIMIT, LIMIT)
                total += x.T @ x
        yield pd.DataFrame({"m": [total.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for batch in batches:
            for m in batch["m"]:
                total += np.frombuffer(m).reshape(d, d)
        yield pd.DataFrame({"m": [total.tobytes()]})

    total = np.zeros((d, d))
    for row in vectors.select("vec").mapInPandas(moment, "m binary").repartition(8).mapInPandas(add, "m binary").collect():
        total += np.frombuffer(row["m"]).reshape(d, d)
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def _pack(block_bytes: int, d: int):
    """Rows become blocks of about so many bytes, in the order in which they come."""
    most = max(1, block_bytes // (8 * d))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def block():
            ids, rows, vecs, norms, least, reach = zip(*held, strict=True)
            width = max(len(_components(v)) for v in vecs)
            kind = np.float64 if any(len(v) % 4 for v in vecs) else np.int32
            numbers = [np.array(x, np.int64).tobytes() for x in (ids, rows)]
            return pd.DataFrame({"ids": numbers[:1], "rows": numbers[1:], "width": [width], "vecs": [_matrix(vecs, width).astype(kind).tobytes()], "norm": [max(norms)], "least": [np.array(least).tobytes()], "reach": [min(reach)]})

        for batch in batches:
            for r in zip(*(batch[c] for c in ("vec_id", "row", "vec", "norm", "least", "reach")), strict=True):
                if len(held) >= most:
                    yield block()
                    held = []
                held.append(r)
        if held:
            yield block()

    return run


PACKED = "ids binary, rows binary, width int, vecs binary, norm double, least binary, reach double"


class _Block:
    """Ids, row numbers and vectors of a packed row."""

    def __init__(self, r, d: int):
        self.ids, self.rows = np.frombuffer(r.ids, np.int64), np.frombuffer(r.rows, np.int64)
        kind = np.float64 if len(r.vecs) > 4 * r.width * len(self.ids) else np.int32
        self.vecs = np.zeros((len(self.ids), d))
        self.vecs[:, : r.width] = np.frombuffer(r.vecs, kind).reshape(len(self.ids), r.width)
        self.norm, self.least = r.norm, np.frombuffer(r.least)


@np.errstate(over="ignore", invalid="ignore")
def _margin(q_norm: np.ndarray, longest: float) -> np.ndarray:
    """More than rounding can move a product of vectors of these lengths."""
    return 1e-6 * (1 + q_norm * longest)


def _first_bounds(seeds, d: int, k: int):
    """Adds ``least``, a lower bound of each query's k-th score, and ``reach``, the length that a candidate needs for it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, vecs, longest = seeds.value
        c = _matrix(vecs, d)
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[at : at + ROWS_AT_ONCE]
                yield part.assign(**dict(zip(("least", "reach"), _bounds(part, rows, c, longest, k), strict=True)))

    return run


@np.errstate(over="ignore", invalid="ignore", divide="ignore")
def _bounds(part: pd.DataFrame, rows: np.ndarray, c: np.ndarray, longest: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    norm, least = part["norm"].to_numpy(), np.full(len(part), -np.inf)
    if len(rows) > k:
        score = _matrix(part["vec"], c.shape[1]) @ c.T
        score[part["row"].to_numpy()[:, None] == rows[None, :]] = -np.inf
        kth = np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k] - _margin(norm, longest)
        least = np.where(np.isfinite(kth), kth, -np.inf)
    # Shorter candidates can't have a score that matters to the query.
    return least, np.where(least > 0, (least - _margin(norm, longest)) / np.maximum(norm, 1e-300) * (1 - 1e-9), -np.inf)


class _Search:
    """The k best of one query block over the candidate blocks fed so far."""

    def __init__(self, block: _Block, rotation: np.ndarray, k: int):
        self.ids, self.own, self.q, self.rotation, self.k = block.ids, block.rows, block.vecs, rotation, k
        self.head = max(1, int(round(HEAD_SHARE * rotation.shape[0])))
        turned = self.q @ rotation
        self.q_head, self.q_rest = turned[:, : self.head], np.sqrt((turned[:, self.head :] ** 2).sum(axis=1))
        self.q_norm = np.sqrt((self.q**2).sum(axis=1))
        self.least = block.least.copy()  # a lower bound of each query's k-th score so far
        self.best = tuple(np.zeros(0, np.int64) for _ in range(3))  # query's place, id, score

    @np.errstate(over="ignore", invalid="ignore")
    def feed(self, block: _Block) -> None:
        """What overflows a bound is no reason to skip a pair."""
        margin = _margin(self.q_norm, block.norm)
        open_ = np.flatnonzero(~(self.q_norm * block.norm + margin < self.least))
        if not len(open_):
            return
        turned = block.vecs @ self.rotation
        head, rest = turned[:, : self.head], np.sqrt((turned[:, self.head :] ** 2).sum(axis=1))
        c_norm = np.sqrt((block.vecs**2).sum(axis=1))
        found = [self._pairs(open_[at : at + ROWS_AT_ONCE], block, head, rest, c_norm, margin) for at in range(0, len(open_), ROWS_AT_ONCE)]
        place, cand, score = (np.concatenate(x) for x in zip(self.best, *found, strict=True))
        order = np.lexsort((cand, -score, place))
        place, cand, score = place[order], cand[order], score[order]
        first = np.searchsorted(place, place, side="left")
        kept = np.arange(len(place)) - first < self.k
        self.best = place[kept], cand[kept], score[kept]
        n = np.bincount(self.best[0], minlength=len(self.ids))
        full = np.flatnonzero(n >= self.k)
        self.least[full] = np.maximum(self.least[full], self.best[2][np.searchsorted(self.best[0], full, side="right") - 1])

    def _pairs(self, some, block: _Block, head, rest, c_norm, margin):
        """Exact scores of the pairs of ``some`` queries whose bounds reach their k-th score."""
        bound = self.q_head[some] @ head.T + self.q_rest[some, None] * rest + margin[some, None]
        row, col = np.nonzero(~(bound < self.least[some, None]))
        if len(row) * 4 > bound.size:
            score = (self.q[some] @ block.vecs.T)[row, col]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", self.q[some[row[a : a + 65536]]], block.vecs[col[a : a + 65536]]) for a in range(0, len(row), 65536)] or [np.zeros(0)])
        row = some[row]
        wide = np.flatnonzero(~(self.q_norm[row] * c_norm[col] < EXACT))
        score[wide] = 0
        score = score.astype(np.int64)
        for at in wide:
            whole = sum(int(a) * int(b) for a, b in zip(self.q[row[at]].tolist(), block.vecs[col[at]].tolist(), strict=True))
            score[at] = max(-MOST, min(MOST, whole))
        good = (score >= self.least[row]) & (self.own[row] != block.rows[col])
        return row[good], block.ids[col[good]], score[good]

    def found(self) -> pd.DataFrame:
        at = self.best[0]
        return pd.DataFrame({"query_row": self.own[at], "query_id": self.ids[at], "vec_id": self.best[1], "score": self.best[2]})


def top_k(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row whose ``vec_id`` is divisible by ``query_every``."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    whole = vectors.select("vec_id", "embedding").mapInPandas(_quantise, "vec_id long, vec binary, size int, norm double")
    whole = checkpoint(whole.withColumn("row", F.monotonically_increasing_id()))
    is_query = F.col("vec_id") % query_every == 0
    size = whole.agg(F.max("size").alias("w"), F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    d = max(1, size["w"] or 0)
    held = sc.broadcast(_rotation(whole, d))

    longest = whole.orderBy(F.col("norm").desc(), "row").limit(SEEDS).select("row", "vec", "norm").collect()
    seeds = sc.broadcast((np.array([r["row"] for r in longest], np.int64), [r["vec"] for r in longest], max((r["norm"] for r in longest), default=0.0)))
    bounded = whole.where(is_query).select("vec_id", "row", "vec", "norm").mapInPandas(_first_bounds(seeds, d, k), "vec_id long, row long, vec binary, norm double, least double, reach double")
    alike = bounded.repartitionByRange("reach", F.xxhash64("row")).sortWithinPartitions("reach", "row")
    queries = checkpoint(alike.mapInPandas(_pack(QUERY_BYTES, d), PACKED).withColumn("block", F.monotonically_increasing_id()))
    reaches = queries.select("block", "reach").orderBy("reach", "block").toPandas()
    if reaches.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    numbers = {b: i for i, b in enumerate(reaches["block"].tolist())}
    needed = sc.broadcast(reaches["reach"].to_numpy())
    candidate_blocks = -(-size["n"] * 8 * d // CANDIDATE_BYTES)
    slices = max(1, min(candidate_blocks, -(-2 * sc.defaultParallelism // len(numbers))))
    tasks = len(numbers) * slices

    longest_first = whole.repartitionByRange(F.col("norm").desc(), F.xxhash64("row")).sortWithinPartitions(F.col("norm").desc(), "row")
    blocks = longest_first.select("vec_id", "row", "vec", "norm", F.lit(0.0).alias("least"), F.lit(0.0).alias("reach")).mapInPandas(_pack(CANDIDATE_BYTES, d), PACKED)

    def to_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each candidate block goes to the query blocks whose reach its longest vector has."""
        for batch in batches:
            for i in range(len(batch)):
                one = batch.iloc[[i]]
                n = int(np.searchsorted(needed.value, one["norm"].iloc[0], side="right"))
                at = zlib.crc32(one["rows"].iloc[0]) % slices
                for q in range(n):
                    yield one.assign(kind=1, task=q * slices + at)

    def to_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.iloc[[i]]
                for at in range(slices):
                    yield one.drop(columns="block").assign(kind=0, task=numbers[one["block"].iloc[0]] * slices + at)

    sent = PACKED + ", kind int, task int"
    dealt = queries.mapInPandas(to_slices, sent).unionByName(blocks.mapInPandas(to_queries, sent))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, running = None, []
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.task != task:
                    yield from (s.found() for s in running)
                    task, running = r.task, []
                block = _Block(r, d)
                if r.kind == 0:
                    running.append(_Search(block, held.value, k))
                else:
                    for s in running:
                        s.feed(block)
        yield from (s.found() for s in running)

    found = dealt.repartitionById(tasks, F.col("task")).sortWithinPartitions("task", "kind", F.col("norm").desc()).mapInPandas(search, "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir: str) -> DataFrame:
    """Contract of op3 over all of ``embeddings``."""
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


OP3_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY s.r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
