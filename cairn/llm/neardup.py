"""Near duplicates by DartMinHash: weighted signatures, a banded join, exact verification, components.

A text is the multiset of its five-word shingles.  Texts whose weighted Jaccard similarity (shared counts over all
counts) is ``SIMILARITY`` or more are linked, equal texts always are, and a class is a connected component.

1. Equal texts become one node (by SHA-256).  A scan computes each node's signature of ``K`` darts; ``BANDS`` bands
   of ``ROWS`` darts each make its buckets.  At similarity 0.8 a pair misses all buckets with probability 3e-6.
2. In each bucket every member is compared with the bucket's least member only, so that a bucket of m members
   gives m - 1 candidates.  Candidates are verified on the exact shingle counts, and verified ones joined.
3. Buckets that still hold more than one component may hide links between members other than the least.  Members of
   one component need no comparison, so the largest component of a bucket is cut into pieces, each of which goes to
   the blocks of the other members, and only those meet each other as well.  Blocks and pieces have bounded bytes;
   each pair is one group, in which members of different components are compared by signature, verified exactly where the signatures don't rule it out (agreement below
   ``MAYBE`` has probability under 1e-6 at 0.8), and only a spanning forest of the found links is returned.

Scale.  Shuffled rows are one node, its bands, and the shingle counts of nodes that share a bucket; text is
shuffled once, to bring the counts of those nodes together.  A bucket, copy group or component of any size meets
only map-side combined aggregations and joins with one row a key on the other side, which can be split; nothing
but row counts reaches the driver.

Defined results: null text counts as the empty text; texts without words match only equal texts; texts of fewer
than five words have one shingle; ``class_id`` is the smallest doc_id of the class (null only if all are null);
repeated rows share a class; an empty table gives an empty result.  Extra columns pass through ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bound_batches, checkpoint, compact, table, text_or_empty
from cairn.llm.components import components
from cairn.llm.darts import signatures, weighted_jaccard
from cairn.llm.shingles import mix, shingles

SIMILARITY = 0.8
ROWS, BANDS = 4, 24
K = ROWS * BANDS
MAYBE = 0.58
#: Bytes of a block of a bucket's members, and of a piece of its largest component.
BLOCK_BYTES, PIECE_BYTES = 8 << 20, 1 << 20


def _sign(texts: pd.Series) -> pd.DataFrame:
    sig: list = [None] * len(texts)
    bands: list = [None] * len(texts)
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    for row, element, count in shingles(texts):
        mine, dense = np.unique(row, return_inverse=True)
        s = signatures(dense, element, count, len(mine), K)
        parts = s.reshape(len(mine), BANDS, ROWS)
        with np.errstate(over="ignore"):
            h = salt[None, :].repeat(len(mine), axis=0)
            for r in range(ROWS):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
        for i, at in enumerate(mine):
            sig[at], bands[at] = s[i].astype(np.uint8).tobytes(), h[i].view(np.int64).tolist()
    return pd.DataFrame({"sig": sig, "bands": bands})


def _counts(texts: pd.Series) -> pd.Series:
    out: list = [b""] * len(texts)
    for row, element, count in shingles(texts):
        cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        for s, e in zip(cut, [*cut[1:], len(row)], strict=True):
            out[row[s]] = element[s:e].tobytes() + count[s:e].astype(np.uint32).tobytes()
    return pd.Series(out)


def _read(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint32, n, 8 * n).astype(np.int64)


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_jaccard(_read(x), _read(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def _key():
    return F.unhex(F.sha2(text_or_empty().cast("binary"), 256))


def _nodes(docs: DataFrame, n: int) -> DataFrame:
    """One row a text: ``key, first_id, n`` (rows), ``sig, bands, id``; ``n`` is also the number of rows of ``docs``."""
    signed = docs.select("doc_id", _key().alias("key"), F.pandas_udf(_sign, "sig binary, bands array<long>")(text_or_empty()).alias("s"))
    nodes = signed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.first("s").alias("s"))
    nodes = nodes.select("key", "first_id", "n", "s.sig", "s.bands", F.monotonically_increasing_id().alias("id"))
    return checkpoint(compact(nodes, n))


def _shingle_counts(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``id, counts`` of the nodes in ``wanted`` (key, first_id, id)."""
    texts = docs.select(F.col("doc_id").alias("first_id"), _key().alias("key"), text_or_empty().alias("text"))
    wanted = wanted.select("key", F.col("first_id").alias("f"), "id")
    found = texts.join(wanted, "key").where(F.col("first_id").eqNullSafe(F.col("f"))).select("id", F.pandas_udf(_counts, "binary")("text").alias("counts"))
    return checkpoint(compact(found.dropDuplicates(["id"]), n))


def _verified(pairs: DataFrame, counts: DataFrame, similarity: float) -> DataFrame:
    a = counts.select(F.col("id").alias("a"), F.col("counts").alias("ca"))
    b = counts.select(F.col("id").alias("b"), F.col("counts").alias("cb"))
    found = pairs.join(a, "a").join(b, "b")
    return found.where(F.pandas_udf(_similarity, "double")("ca", "cb") >= similarity).select("a", "b")


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of batches sorted by bucket, i and j, a group at a time."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        key = batch[["bucket", "i", "j"]].to_numpy()
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for s, e in zip([0, *cut[:-1]], cut, strict=False):
            yield batch.iloc[s:e]
        rest = batch.iloc[cut[-1] if len(cut) else 0 :]
    if rest is not None and len(rest):
        yield rest


def _links(group: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between members of different components, of one block or two."""
    order = np.argsort(group["id"].to_numpy(), kind="stable")
    ids, comp, side = (group[c].to_numpy()[order] for c in ("id", "component", "block"))
    if (comp == comp[0]).all():
        return []
    sig = np.frombuffer(b"".join(group["sig"].to_numpy()[order]), np.uint8).reshape(len(ids), K)
    counts, one_block = group["counts"].to_numpy()[order], group["i"].iloc[0] == group["j"].iloc[0]
    root = {c: c for c in comp.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sets: dict[int, tuple] = {}
    read = lambda x: sets.get(x) or sets.setdefault(x, _read(counts[x]))
    out = []
    for x in range(len(ids) - 1):
        others = x + 1 + np.flatnonzero((comp[x + 1 :] != comp[x]) & (one_block | (side[x + 1 :] != side[x])))
        if len(others):
            others = others[np.count_nonzero(sig[others] == sig[x], axis=1) >= MAYBE * K]
        for y in others.tolist():
            a, b = find(int(comp[x])), find(int(comp[y]))
            if a != b and weighted_jaccard(read(x), read(y)) >= similarity:
                root[a] = b
                out.append((int(ids[x]), int(ids[y])))
    return out


def _within(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int]] = []
        for group in _groups(batches):
            found += _links(group, similarity)
            if len(found) > 10_000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row a distinct text: ``key, class`` (an internal number), ``first_id, n``."""
    bound_batches(docs.sparkSession)
    n = docs.count()
    nodes = _nodes(docs, n)
    rows = nodes.where(F.col("bands").isNotNull()).select("id", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.min("id").alias("least"), F.count("*").alias("m")).where(F.col("m") > 1).select("bucket", "least")
    buckets = checkpoint(compact(buckets, n))
    members = checkpoint(compact(rows.join(buckets, "bucket"), n))
    pairs = members.where(F.col("id") != F.col("least")).select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    pairs = checkpoint(compact(pairs, n))
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    counts = _shingle_counts(docs, nodes.select("key", "first_id", "id").join(wanted, "id"), n)
    links = checkpoint(_verified(pairs, counts, similarity))
    joined = components(links)

    component = F.coalesce("component", "id").alias("component")
    placed = members.select("bucket", "id").join(joined.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", component)
    placed = checkpoint(compact(placed, n))
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where(F.col("lo") < F.col("hi")).select("bucket")
    open_ = checkpoint(compact(open_, n))
    # Blocks are laid out on narrow rows; signatures and counts join last.
    inside = placed.join(open_, "bucket")
    sizes = counts.select("id", (F.octet_length("counts") + K).alias("w"))
    parts = inside.join(sizes, "id").groupBy("bucket", "component").agg(F.sum("w").alias("w"))
    parts = parts.groupBy("bucket").agg(F.max(F.struct("w", "component")).alias("top"), F.sum("w").alias("w"))
    few = F.greatest(F.lit(1), F.ceil((F.col("w") - F.col("top.w")) / F.lit(BLOCK_BYTES)))
    parts = checkpoint(compact(parts.select("bucket", F.col("top.component").alias("largest"), few.alias("few"), F.ceil(F.col("top.w") / F.lit(PIECE_BYTES)).alias("many")), n))
    inside = inside.join(parts, "bucket").withColumn("is_large", F.col("component") == F.col("largest"))
    at = F.xxhash64("id")
    inside = inside.withColumn("block", F.when(F.col("is_large"), F.col("few") + F.pmod(at, F.col("many"))).otherwise(F.pmod(at, F.col("few"))))
    others = F.when(F.col("is_large"), F.col("few")).otherwise(F.col("few") + F.col("many"))
    inside = inside.select("bucket", "id", "component", "block", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)).alias("other"))
    inside = checkpoint(compact(inside.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "component", "block"), n))
    full = inside.join(nodes.select("id", "sig").join(counts, "id"), "id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = full.mapInPandas(_within(similarity), "a long, b long")
    joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    final = nodes.select("key", "first_id", "n", "id").join(joined.withColumnRenamed("node", "id"), "id", "left")
    return checkpoint(compact(final.select("key", "first_id", "n", F.coalesce("component", "id").alias("class")), n))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, class_rows`` for every row of ``docs`` (doc_id, text)."""
    found = classes(docs, similarity)
    named = checkpoint(found.groupBy("class").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_rows")))
    by_text = checkpoint(found.select("key", "class").join(named, "class").select("key", "class_id", "class_rows"))
    return docs.select("doc_id", _key().alias("key")).join(by_text, "key").select("doc_id", "class_id", "class_rows")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class: that of the smallest doc_id (a null one only if there is no other)."""
    found = classes(docs.select("doc_id", "text"), similarity)
    order = F.struct(F.col("first_id").isNull(), "first_id", "key")
    kept = checkpoint(found.groupBy("class").agg(F.min(order).alias("k")).select(F.col("k.key").alias("_near_key"), F.col("k.first_id").alias("_near_id")))
    out = docs.withColumn("_near_key", _key()).join(kept, "_near_key").where(F.col("doc_id").eqNullSafe(F.col("_near_id")))
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).limit(1).count()
    if repeated:
        out = out.dropDuplicates(["_near_key"])
    return out.drop("_near_key", "_near_id")


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its class, over all of ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
