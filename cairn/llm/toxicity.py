"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training takes a bounded sample of the labelled rows: at most ``PER_CLASS`` documents of each class, chosen by
the md5 of their ids (the bound is the parameter ``per_class``).  Character n-grams of 4 to 6 code points (with
the blank border of a text) are hashed; each hash gets the log ratio of its smoothed document shares in the two
classes, the ``FEATURES`` hashes of largest chi-square are kept, and a logistic regression on presence times
ratio is fitted with ridge penalty on the driver, from one short integer list a sampled document.

Scoring is one scan of whole texts by a vectorised function that holds the model (about 2 MB) and one batch;
texts beyond ``PIECE`` code points are hashed in overlapping pieces, so memory does not follow a text's length.
Nothing is shuffled but the sample, whose n-grams are counted in all its partitions and summed by ``SUMS`` tasks.

Defined results: null text scores as the empty text; of repeated labels of a document the larger counts; null
labels and labels without a document are ignored; with only one class among the labels the score is the share
of toxic ones, and 0 without labels.  Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import checkpoint, fold, table, text_or_empty

PER_CLASS = 4000
FEATURES = 8192
ORDERS = (4, 5, 6)
BITS = 19
PIECE = 1 << 20
THRESHOLD = 0.3
#: Sampled rows of a partition, and tasks that sum up the partitions' counts.
PART_ROWS, SUMS = 256, 4
_BORDER = "\0" * max(ORDERS)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _pieces(texts) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Lower-cased texts as code points, joined up to PIECE: (rows, their starts, code points)."""
    rows, starts, parts, size = [], [], [], 0

    def joined():
        return rows, np.array(starts), np.frombuffer("".join([*parts, _BORDER]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)

    for row, text in enumerate(texts):
        text = _BORDER + text.lower()
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE + max(ORDERS) - 1]
            if size and size + len(piece) > PIECE:
                yield joined()
                rows, starts, parts, size = [], [], [], 0
            rows.append(row)
            starts.append(size)
            parts.append(piece)
            size += len(piece)
    if rows:
        yield joined()


def _hashes(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the hash of the n-gram that starts at each code point."""
    wide = codes.astype(np.uint64) + np.uint64(1)
    total, factor = np.zeros(len(wide), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(max(ORDERS)):
            shifted = wide[j:] * factor
            total[: len(shifted)] += shifted
            factor *= _STEP
            if j + 1 in ORDERS:
                mixed = (total ^ (total >> np.uint64(31))) * _MIX
                yield (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every feature that a text has, once each, by row; ``slots`` maps hashes to features or -1."""
    keys = []
    for rows, starts, codes in _pieces(texts):
        last = len(codes) - max(ORDERS)
        for h in _hashes(codes):
            got = slots[h[:last]]
            at = np.flatnonzero(got >= 0)
            piece = np.searchsorted(starts, at, side="right") - 1
            # The overlap at a piece's end belongs to the next piece.
            own = at - starts[piece] < PIECE
            doc = np.asarray(rows)[piece[own]]
            keys.append(np.unique(doc.astype(np.int64) * (1 << 32) + got[at[own]]))
    merged = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return merged >> 32, merged & 0xFFFFFFFF


def _fit(ptr: np.ndarray, idx: np.ndarray, y: np.ndarray, ratio: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 120):
    """Ridge logistic regression by accelerated gradient descent; (weights times ratios, bias)."""
    n, k = len(y), len(ratio)
    lengths = np.diff(ptr)
    rows = np.repeat(np.arange(n), lengths)
    scale = 1.0 / max(1.0, 0.25 * float(np.mean(np.bincount(rows, weights=ratio[idx] ** 2, minlength=n))))
    w, b = np.zeros(k), float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    vw, vb, step = w.copy(), b, scale
    for t in range(steps):
        z = np.bincount(rows, weights=(vw * ratio)[idx], minlength=n) + vb
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / weight.mean() / n
        grad = np.bincount(idx, weights=err[rows], minlength=k) * ratio + penalty / n * vw
        new_w, new_b = vw - step * grad, vb - step * err.sum()
        m = t / (t + 3)
        vw, vb = new_w + m * (new_w - w), new_b + m * (new_b - b)
        w, b = new_w, new_b
    return (w * ratio).astype(np.float32), b


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray, float]:
    """The model (slots, weights, bias) from ``labels`` (doc_id, toxic) and the texts of ``docs``."""
    sc = docs.sparkSession.sparkContext
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_tox_y"))
    counts = {r["_tox_y"]: r["n"] for r in labels.groupBy("_tox_y").agg(F.count("*").alias("n")).collect()}
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    chosen = [labels.where(F.col("_tox_y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    sample = docs.select("doc_id", text_or_empty().alias("_tox_text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    # The scan and the join keep the table's partitions; only the sample is dealt anew.
    size = min(sum(counts.values()), 2 * per_class)
    sample = checkpoint(sample.select(F.col("_tox_text").alias("text"), F.col("_tox_y").alias("y")).repartition(max(1, -(-size // PART_ROWS))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, every = np.zeros((2, 1 << BITS), np.int32), np.arange(1 << BITS, dtype=np.int64)
        docs_seen = np.zeros(2, np.int64)
        for batch in batches:
            for y in (0, 1):
                texts = list(batch["text"][batch["y"] == y])
                docs_seen[y] += len(texts)
                for at in range(0, len(texts), 64):
                    n[y] += np.bincount(features(texts[at : at + 64], every)[1], minlength=1 << BITS).astype(np.int32)
        yield pd.DataFrame({"n": [n.tobytes()], "docs": [docs_seen.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, docs_seen = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for some, seen in zip(batch["n"], batch["docs"], strict=True):
                n += np.frombuffer(some, np.int32).reshape(2, -1)
                docs_seen += np.frombuffer(seen, np.int64)
        yield pd.DataFrame({"n": [n.tobytes()], "docs": [docs_seen.tobytes()]})

    n, seen, vectors = np.zeros((2, 1 << BITS)), np.zeros(2), "n binary, docs binary"
    for r in sample.mapInPandas(count, vectors).repartition(SUMS).mapInPandas(add, vectors).collect():
        n += np.frombuffer(r["n"], np.int32).reshape(2, -1)
        seen += np.frombuffer(r["docs"], np.int64)
    slots = np.full(1 << BITS, -1, np.int32)
    if not seen.all():
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        return slots, np.zeros(1, np.float32), float(np.log(share / (1 - share))) if 0 < share < 1 else (30.0 if share else -30.0)

    total, all_docs = n.sum(axis=0), seen.sum()
    expected = total * seen[1] / all_docs
    chi = (n[1] - expected) ** 2 / np.maximum(expected * (1 - total / all_docs) * (seen[0] / all_docs), 1e-9)
    chi[(total < 4) | (total >= all_docs)] = 0
    kept = np.sort(np.argsort(-chi, kind="stable")[:FEATURES])
    kept = kept[chi[kept] > 0]
    slots[kept] = np.arange(len(kept))
    ratio = np.log((n[1, kept] + 1) / (seen[1] + 2)) - np.log((n[0, kept] + 1) / (seen[0] + 2))
    held = sc.broadcast(slots)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                row, feature = features(list(part["text"]), held.value)
                cuts = np.split(feature.astype(np.int32), np.searchsorted(row, np.arange(1, len(part))))
                yield pd.DataFrame({"f": [c.tobytes() for c in cuts], "y": part["y"].to_numpy()})

    table = sample.mapInPandas(listed, "f binary, y int").toArrow()
    lists, y = [np.frombuffer(x.as_buffer(), np.int32) for x in table.column("f")], table.column("y").to_numpy().astype(float)
    weight = np.where(y == 1, counts[1] / seen[1], counts[0] / seen[0])
    idx = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    weights, bias = _fit(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), idx, y, ratio, weight)
    return slots, weights, bias


def scorer(spark, model):
    """A column function: text -> score from 0 to 1."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots, weights, bias = held.value
        for texts in batches:
            row, feature = features(texts, slots)
            z = np.bincount(row, weights=weights[feature].astype(float), minlength=len(texts)) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, column: str = "score", per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` plus ``column``, learning from ``labels`` whose fold (of 4) is not 2."""
    model = train(docs, labels.where(fold() != 2), per_class)
    return docs.withColumn(column, scorer(docs.sparkSession, model)(text_or_empty()))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    return score_documents(docs, labels, "_tox_score").where(F.col("_tox_score") < threshold).drop("_tox_score")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract of op1 over all of ``documents``."""
    scored = score_documents(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return scored.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
