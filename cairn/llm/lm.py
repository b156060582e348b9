"""LM scoring: a gated recurrent model with class-factored output, trained and applied over the whole corpus.

1. All tokens of the training documents are counted (per task, then by word).
2. Words are ordered by count.  The most frequent ``BLOCKS * BLOCK`` are the model's head, in blocks of one class
   each; further words whose count reaches a level that at most ``KNOWN`` words reach fall into classes of about
   equal frequency, in which a word has its share of the class's count; all other words, unseen ones included,
   are one tail class, in which a word has (count + 1) of the tail's sum of (count + 1), plus 1.
3. One scan turns all texts into ids of classes and head words (two bytes a token) and lists their tail words.
4. The recurrent network starts as the unigram model.  The training texts are dealt by a hash of id and text into
   shards of about ``SHARD_TOKENS`` tokens, sorted by that hash.  Every round trains a copy on windows of each shard's
   stream with truncated backpropagation, and the copies are averaged by their tokens.  The rounds share out the
   segments of each stream, so every training token is learned from once.  Shards depend on the rows alone, not on
   files, partitions or machines, and sums are added in the order of shards: the model does not change with layout.
5. Documents are scored from their ids with the state carried to each document's end; tail words meet their counts
   in a join.

Scale.  The broadcast table holds at most ``KNOWN`` words of at most ``LONGEST`` bytes; longer words are tail words.
Counts, tail words and sums are shuffled with map-side combining; per document one row; ids of training texts are
dealt once.  Rows that agree in id and text share a shard.  The network (under 1 MB) is averaged by a tree of ``FAN``
branches a node.  Lineage is cut after the counts, the ids and the shards.

Defined results: null text is the empty text, which has the end token alone; a null id is in the fold of the
empty string; repeated rows get equal results; without training documents every text has probability 1 under
both models; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import checkpoint, fold, table, text_or_empty
from cairn.llm.gru import BLOCK, HIDDEN, WINDOW, Gru, Trainer, score_documents

BLOCKS, MIDDLE = 32, 31
KNOWN, LONGEST = 1 << 18, 64
ROUNDS, SEGMENT, LANES, RATE = 2, 2 * WINDOW, 128, 0.03
#: Training tokens of a shard, and shards whose sums are added at once.
SHARD_TOKENS, FAN = 1 << 21, 64
FLUSH = 400_000
#: No word holds white space, so this one stands for a document's end.
END = b"\n"


def tokens(text: bytes) -> list[bytes]:
    """Words between spaces, tabs, line and page breaks; A-Z in lower case (bytes.lower folds nothing else)."""
    out = text.lower().split()
    out.append(END)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column("text"):
            n.update(tokens(text.as_py()))
            if len(n) > FLUSH:
                yield out()
                n.clear()
    if n:
        yield out()


class Vocabulary:
    """What scoring needs of the counts: for each known word its place, and by place id, log count, log share."""

    def __init__(self, words: list[bytes], counts: np.ndarray, all_tokens: int, all_words: int):
        order = sorted(range(len(words)), key=lambda i: (words[i] != END, -counts[i], words[i]))
        head = BLOCKS * BLOCK
        n = np.asarray(counts, float)[order]
        self.place = {words[i]: k for k, i in enumerate(order)}
        self.unknown = len(order)
        middle = n[head:]
        band = np.minimum((np.cumsum(middle) / max(middle.sum(), 1.0) * MIDDLE).astype(np.int64), MIDDLE - 1)
        self.ids = np.concatenate([np.arange(min(len(n), head)), head + band, [head + MIDDLE]]).astype(np.int32)
        mass = np.bincount(self.ids[:-1], weights=n, minlength=head + MIDDLE + 1)
        self.log_share = np.zeros(len(n) + 1)
        self.log_share[head:-1] = np.log(middle / mass[head + band])
        self.log_count = np.append(np.log10(n + 1), 0.0)
        self.tail_tokens, self.tail_words = all_tokens - int(n.sum()), all_words - len(n)
        mass[-1] = max(self.tail_tokens, 1)
        self.unigrams = mass / mass.sum()

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, repeat(self.unknown)), np.int32, len(words))


ENCODED = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("share", pa.float64()),
    ("ids", pa.binary()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32())),
])
ENCODED_DDL = "doc_id long, held_out boolean, place long, n_tokens long, n_known long, base double, share double, ids binary, words array<binary>, times array<int>"


def _encode(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        for batch in batches:
            rows = []
            for doc, held_out, place, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "place", "text")), strict=True):
                words = tokens(text)
                p = vocabulary.places(words)
                tail = Counter([words[i] for i in np.flatnonzero(p == vocabulary.unknown).tolist()])
                sums = float(vocabulary.log_count[p].sum()), float(vocabulary.log_share[p].sum())
                rows.append((doc, held_out, place, len(words), len(words) - tail.total(), *sums, vocabulary.ids[p].astype(np.int16).tobytes(), list(tail), list(tail.values())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ENCODED, strict=True)], schema=ENCODED)

    return run


def _learn(held, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for now, data in zip(batch.column("shard").to_pylist(), batch.column("ids"), strict=True):
                if now != shard:
                    if shard is not None:
                        yield from copy.end()
                    shard, copy = now, _Copy(now, pickle.loads(held.value), round_)
                copy.feed(np.frombuffer(data.as_buffer(), np.int16))
        if shard is not None:
            yield from copy.end()

    return run


class _Copy:
    """A copy of the network that learns from the segments of one round in one shard's stream."""

    def __init__(self, shard: int, model: Gru, round_: int):
        self.shard, self.trainer, self.round = shard, Trainer(model, RATE), round_
        self.part, self.segments, self.seen, self.used = [], [], 0, 0

    def feed(self, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            segment, inside = divmod(self.seen, SEGMENT)
            end = min(at + SEGMENT - inside, len(ids))
            if segment % ROUNDS == self.round:
                self.part.append(ids[at:end])
                if inside + end - at == SEGMENT:
                    self.close()
            self.seen += end - at
            at = end

    def close(self) -> None:
        self.segments.append(np.concatenate(self.part))
        self.part = []
        if len(self.segments) == LANES:
            self.learn()

    def learn(self) -> None:
        lengths = np.array([len(x) for x in self.segments])
        lanes = np.zeros((len(lengths), SEGMENT), np.int32)
        live = np.arange(SEGMENT) < lengths[:, None]
        lanes[live] = np.concatenate(self.segments)
        state = np.zeros((len(lanes), HIDDEN), np.float32)
        for at in range(0, lengths.max(), WINDOW):
            state = self.trainer.window(lanes[:, at : at + WINDOW], state, live[:, at : at + WINDOW])
        self.used += int(lengths.sum())
        self.segments.clear()

    def end(self) -> Iterator[pa.RecordBatch]:
        """The learned parameters times the tokens that they were learned from; unfinished segments come first."""
        if self.part:
            self.close()
        if self.segments:
            self.learn()
        if self.used:
            flat = np.concatenate([x.ravel() for x in self.trainer.model.p.values()]).astype(np.float64) * self.used
            yield _sums(self.shard, flat, self.used)


def _sums(shard: int, p: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([p.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["shard", "p", "n"])


SUMS_DDL = "shard long, p binary, n long"


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows sorted by shard, FAN neighbouring shards to one."""
    now, total, n = None, None, 0
    for batch in batches:
        for shard, p, k in zip(*(batch.column(c) for c in ("shard", "p", "n")), strict=True):
            group, x = shard.as_py() // FAN, np.frombuffer(p.as_buffer())
            if group != now:
                if now is not None:
                    yield _sums(now, total, n)
                now, total, n = group, np.zeros_like(x), 0
            total, n = total + x, n + k.as_py()
    if now is not None:
        yield _sums(now, total, n)


def train(streams: DataFrame, shards: int, unigrams: np.ndarray) -> Gru:
    """The network after ``ROUNDS`` rounds over ``streams`` (shard, ids), sorted within each shard."""
    model = Gru.fresh(unigrams, BLOCKS)
    sc = streams.sparkSession.sparkContext
    for round_ in range(ROUNDS):
        held = sc.broadcast(pickle.dumps(model))
        sums, left = streams.mapInArrow(_learn(held, round_), SUMS_DDL), shards
        while left > FAN:
            left = -(-left // FAN)
            sums = sums.repartitionById(left, (F.col("shard") / FAN).cast("int")).sortWithinPartitions("shard").mapInArrow(_add, SUMS_DDL)
        rows = sorted(sums.collect(), key=lambda r: r["shard"])
        n = sum(r["n"] for r in rows)
        if n:
            mean, at = (sum(np.frombuffer(r["p"]) for r in rows) / n).astype(np.float32), 0
            for k, v in model.p.items():
                model.p[k] = mean[at : at + v.size].reshape(v.shape)
                at += v.size
        held.unpersist()
    return model


#: Texts scored side by side hold about this many tokens (one text may hold more).
GROUP = 1 << 20
SCORED = pa.schema([*(ENCODED.field(c) for c in ("doc_id", "held_out", "place", "n_tokens", "n_known", "base")), ("model", pa.float64())])
SCORED_DDL = "doc_id long, held_out boolean, place long, n_tokens long, n_known long, base double, model double"


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(held.value)
        for batch in batches:
            lengths = batch.column("n_tokens").to_numpy()
            group = (np.cumsum(lengths) - lengths) // GROUP
            for g in np.unique(group):
                s, e = np.searchsorted(group, [g, g + 1])
                ids = np.concatenate([np.frombuffer(x.as_buffer(), np.int16) for x in batch.column("ids")[s:e]]).astype(np.int32)
                ll = score_documents(model, ids, lengths[s:e]) + batch.column("share").to_numpy()[s:e]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(s, e - s) for c in SCORED.names[:-1]), pa.array(ll, pa.float64())], schema=SCORED)

    return run


def score(docs: DataFrame, parts: int = 7, held_out: int = 2) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text), learning from those whose fold of ``parts`` is not ``held_out``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", (fold("doc_id", parts) == held_out).alias("held_out"), text_or_empty().cast("binary").alias("text"))
    training = docs.where(~F.col("held_out")).select("text")
    counts = checkpoint(training.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()

    short = F.octet_length("word") <= LONGEST
    least, reached = 1 << 62, 0
    for row in counts.where(short).groupBy("n").agg(F.count("*").alias("v")).orderBy(F.col("n").desc()).limit(KNOWN + 1).collect():
        if reached + row["v"] > KNOWN:
            break
        least, reached = row["n"], reached + row["v"]
    known = short & (F.col("n") >= least)
    listed = counts.where(known).toArrow()
    vocabulary = Vocabulary(listed.column("word").to_pylist(), listed.column("n").to_numpy(), totals["n"], totals["v"])

    # A document's place decides its shard and its turn there, wherever its row is stored.
    held = spark.sparkContext.broadcast(vocabulary)
    placed = docs.select("doc_id", "held_out", F.xxhash64("doc_id", "text").alias("place"), "text")
    encoded = checkpoint(placed.mapInArrow(_encode(held), ENCODED_DDL).withColumn("id", F.monotonically_increasing_id()))
    shards = max(1, -(-totals["n"] // SHARD_TOKENS))
    streams = encoded.where(~F.col("held_out")).select(F.pmod("place", F.lit(shards)).cast("int").alias("shard"), "place", "ids")
    streams = checkpoint(streams.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place", "ids").select("shard", "ids"))
    model = train(streams, shards, vocabulary.unigrams)

    held = spark.sparkContext.broadcast(pickle.dumps(model))
    scored = encoded.select("doc_id", "held_out", F.col("id").alias("place"), "n_tokens", "n_known", "base", "share", "ids").mapInArrow(_score(held), SCORED_DDL)
    pairs = encoded.select("id", F.explode(F.arrays_zip("words", "times")).alias("w")).select("id", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    met = pairs.join(counts.where(~known).select("word", "n"), "word", "left")
    tail = met.groupBy("id").agg(
        F.sum("times").alias("_tail"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("_seen"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("_log")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    all_ = float(np.log10(totals["n"] + totals["v"] + 1))
    tail_all = float(np.log10(vocabulary.tail_tokens + vocabulary.tail_words + 1))
    out = scored.withColumnRenamed("place", "id").join(tail, "id", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("_seen")).alias("n_known"), F.lit(totals["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + zero("_log") - F.col("n_tokens") * F.lit(all_)).alias("base_score"),
        F.when(F.lit(totals["n"]) == 0, F.lit(0.0)).otherwise(F.col("model") / F.lit(float(np.log(10))) + zero("_log") - zero("_tail") * F.lit(tail_all)).alias("score"),
    )


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Contract of op2 over all of ``documents``."""
    return score(table(spark, sf_dir, "documents", "doc_id", "text"))
