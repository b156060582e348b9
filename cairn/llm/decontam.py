"""Benchmark decontamination as a prefix-filtered containment join.

The sets to be found are windows of ``WINDOW`` consecutive words of a benchmark item (all its words, if it has
fewer).  A window must be contained whole, so of its words in order of rarity the necessary prefix is the rarest
one alone.  Rarity is the words' count over all of ``documents``.  Each document looks up its words among those
prefix words; at a hit the positional bound (the place of the prefix word within the window) fixes where the
window would lie, the length bound drops windows that would cross the document's ends, and the words there are
compared exactly.

Scale.  Windows, counts and prefix words are tables.  Their size is measured first, and decides how documents meet
them; both ways are exact.  Up to ``BROADCAST_WORDS`` words in all windows, the prefix table is broadcast, documents
are never shuffled, and work per word is bounded by the window length, not by how often a word or a window occurs.
Beyond it, a scan of the documents sends each place where a prefix word may stand as the words that the window would
cover, and those meet the windows in an equi-join on the words themselves.  A filter of ``1 << SLOT_BITS`` bits, whatever
the benchmark's size, keeps words back that are nobody's prefix; what it lets through wrongly the join drops.  Hits
are gathered by the text's digest, bounded by the words of one text.

Defined results: null text has no words; an item or document without words matches nothing; equal item ids
count once; a null item_id is ignored; repeated rows get equal results; empty tables give empty results or
clean documents.  Extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import LOWER, UPPER, ascii_lower, checkpoint, table, text_or_empty

WINDOW = 10
#: Words of all windows (once for each item that has them) up to which the prefix table is broadcast.
BROADCAST_WORDS = 1 << 20
#: Bits of the filter beyond that, and words that a task counts before it sends them on.
SLOT_BITS, FLUSH = 22, 400_000
# Fixed value: the contract's word pattern.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(ascii_lower(text))


def item_windows(words: list[str], window: int = WINDOW) -> list[tuple[str, ...]]:
    if len(words) <= window:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``window`` (its words, joined by blanks), ``n`` (their number) and ``item_id``, distinct."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, text in zip(batch["item_id"], batch["text"], strict=True):
                found = {" ".join(w): len(w) for w in item_windows(words_of(text), window)}
                yield pd.DataFrame({"window": list(found), "n": list(found.values()), "item_id": i}).astype({"window": object, "n": "int32", "item_id": object})

    return items.mapInPandas(run, "window string, n int, item_id string").distinct()


def word_counts(docs: DataFrame, vocabulary: set[str] | None) -> DataFrame:
    """``word, n``: how often each word (of ``vocabulary``, where given) occurs in all ``docs``; counted per task, then by word."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary and frozenset(vocabulary))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, n = held.value, Counter()
        out = lambda: pd.DataFrame({"word": list(n), "n": list(n.values())}).astype({"word": object, "n": "int64"})
        for batch in batches:
            for text in batch["text"]:
                words = words_of(text)
                n.update(words if wanted is None else (w for w in words if w in wanted))
                if len(n) > FLUSH:
                    yield out()
                    n.clear()
        yield out()

    return docs.select(text_or_empty().alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``window, n, word, place`` of each distinct window: its rarest word, of equally rare ones the first by name and place."""
    words = windows.select("window", "n").distinct().select("window", "n", F.posexplode(F.split("window", " ", -1)).alias("place", "word"))
    met = words.join(counts.withColumnRenamed("n", "count"), "word", "left")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "word", "place")).alias("r")
    return met.groupBy("window", "n").agg(rarest).select("window", "n", "r.word", "r.place")


class Matcher:
    """Windows, keyed by (prefix word, its place, length), against one document at a time."""

    def __init__(self, rows: list[tuple[str, str, int, list[str]]]):
        """``rows`` has (window, prefix word, place, item ids); words outside the windows share the id 0."""
        self.ids: dict[str, int] = {}
        self.items, places = {}, {}
        for window, word, place, items in rows:
            key = tuple(self.ids.setdefault(x, len(self.ids) + 1) for x in window.split(" "))
            self.items[key] = items
            places.setdefault(self.ids[word], set()).add((place, len(key)))
        self.places = {k: sorted(v) for k, v in places.items()}

    def match(self, words: list[str], cover: list[tuple[int, int]], items: set[str]) -> None:
        get, places, known = self.ids.get, self.places, self.items
        if self.places.keys().isdisjoint(ids := [get(w, 0) for w in words]):
            return
        n = len(ids)
        for at, x in enumerate(ids):
            for place, length in places.get(x, ()):
                start = at - place
                if start < 0 or start + length > n:
                    continue
                if (found := known.get(tuple(ids[start : start + length]))) is not None:
                    cover.append((start, start + length))
                    items.update(found)


def _covered(cover: list[tuple[int, int]]) -> int:
    n = end = 0
    for s, e in sorted(cover):
        if e > end:
            n += e - max(s, end)
            end = e
    return n


FOUND = "n_words long, starts array<long>, ends array<long>, items array<string>"


def _broadcast_pass(held):
    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(held.value)
        for texts in batches:
            rows = []
            for text in texts:
                cover, items = [], set()
                matcher.match(words := words_of(text), cover, items)
                cover = sorted(set(cover))
                rows.append((len(words), [s for s, _ in cover], [e for _, e in cover], sorted(items)))
            yield pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    return run


def _slot(*key) -> int:
    return zlib.crc32(" ".join(map(str, key)).encode("utf-8", "surrogatepass")) & ((1 << SLOT_BITS) - 1)


def _slots(table: DataFrame, *key: str) -> np.ndarray:
    """One byte a slot: 1 where a row's key falls."""
    hashed = F.crc32(F.concat_ws(" ", *[F.col(k).cast("string") for k in key]).cast("binary")).bitwiseAND(F.lit((1 << SLOT_BITS) - 1).cast("long"))
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    out[table.select(hashed.cast("int").alias("s")).distinct().toArrow().column("s").to_numpy()] = 1
    return out


def _candidates(docs: DataFrame, prefix: DataFrame) -> DataFrame:
    """``key, start, n, window``: the words of each place of a text (by its digest) where a window may lie."""
    sc = docs.sparkSession.sparkContext
    shapes = sorted((r["place"], r["n"]) for r in prefix.select("place", "n").distinct().collect())
    held = sc.broadcast((np.packbits(_slots(prefix, "word")), np.packbits(_slots(prefix, "word", "place", "n")), shapes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_in, places_in, shapes = np.unpackbits(held.value[0]), np.unpackbits(held.value[1]), held.value[2]
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                words, rows = words_of(text), []
                for at in np.flatnonzero(words_in[[_slot(w) for w in words]]).tolist() if words else ():
                    for place, n in shapes:
                        start = at - place
                        if start >= 0 and start + n <= len(words) and places_in[_slot(words[at], place, n)]:
                            rows.append((key, start, n, " ".join(words[start : start + n])))
                if rows:
                    yield pd.DataFrame(rows, columns=["key", "start", "n", "window"])

    return docs.mapInPandas(run, "key string, start long, n long, window string")


def _joined_pass(docs: DataFrame, windows: DataFrame, prefix: DataFrame, column: str) -> DataFrame:
    text = text_or_empty()
    key = F.sha2(text.cast("binary"), 256)
    hits = _candidates(docs.select(key.alias("key"), text.alias("text")), prefix).join(windows.select("window", "item_id"), "window")
    places = F.array_sort(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("n")).alias("end"))))
    found = checkpoint(hits.groupBy("key").agg(places.alias("_p"), F.array_sort(F.collect_set("item_id")).alias("_i")).withColumnRenamed("key", f"{column}_key"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    n_words = F.regexp_count(F.translate(text, UPPER, LOWER), F.lit(WORD.pattern)).cast("long")
    value = F.struct(
        n_words.alias("n_words"), F.coalesce(F.transform("_p", lambda x: x["start"]), none("long")).alias("starts"),
        F.coalesce(F.transform("_p", lambda x: x["end"]), none("long")).alias("ends"), F.coalesce("_i", none("string")).alias("items"),
    )
    out = docs.withColumn(column, key).join(found, F.col(column) == F.col(f"{column}_key"), "left")
    return out.withColumn(column, value).select(*docs.columns, column)


def find_windows(docs: DataFrame, benchmark: DataFrame, column: str, window: int = WINDOW) -> DataFrame:
    """``docs`` plus ``column``: a struct of the number of words, the found windows' starts and ends, the item ids."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), text_or_empty().alias("text"))
    windows = checkpoint(windows_of(items, window))
    size = windows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    small = size <= BROADCAST_WORDS
    if not small:
        prefix = checkpoint(prefixes(windows, word_counts(docs, None)))
        return _joined_pass(docs, windows, prefix, column)
    vocabulary = {r["word"] for r in windows.select(F.explode(F.split("window", " ", -1)).alias("word")).distinct().collect()}
    prefix = prefixes(windows, word_counts(docs, vocabulary)) if vocabulary else None
    rows = []
    if prefix is not None:
        ids = windows.groupBy("window").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
        rows = [tuple(r) for r in prefix.join(ids, "window").select("window", "word", "place", "items").collect()]
    return docs.withColumn(column, _broadcast_pass(docs.sparkSession.sparkContext.broadcast(rows))(text_or_empty()))


DIGEST = "n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _digest(found: pd.DataFrame) -> pd.DataFrame:
    out = []
    for s, e, i in zip(found["starts"], found["ends"], found["items"], strict=True):
        n = _covered(list(zip(s, e, strict=True)))
        out.append((n, len(i), hashlib.sha256(",".join(sorted(i)).encode()).hexdigest(), n > 0))
    return pd.DataFrame(out, columns=["n_hit", "n_items", "items_sha256", "contaminated"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of a benchmark item."""
    return find_windows(docs, benchmark, "_decontam", window).where(F.size("_decontam.items") == 0).drop("_decontam")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract of op4 over all of ``documents`` and ``benchmark``."""
    found = find_windows(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), "_f")
    return found.select("doc_id", F.col("_f.n_words").alias("n_words"), F.pandas_udf(_digest, DIGEST)("_f").alias("_d")).select("doc_id", "n_words", "_d.*")


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p : p + least(len(ws), 10) - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM i WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT rid, n, p, array_to_string(ws[p : p + n - 1], ' ') AS w
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, lens WHERE len(ws) >= n)),
h AS (SELECT dw.rid, dw.n, dw.p, iw.item_id FROM dw JOIN iw USING (n, w)),
hw AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM h)) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(hw.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(hi.ids, '')) AS items_sha256, coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
