"""Fixtures of the operators' tests: documents with every awkward row, and plain versions to compare with."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, key string, id string, runs int, component string, bucket string"


def documents(spark, texts, ids=None, sources=None):
    """``texts`` as a documents table with extra columns whose names clash with the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    rows = [(i, t, "en", s, None if t is None else len(t), -1.0, "size", "key", "id", 7, "c", "b") for i, t, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def prose(n, seed=0, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def awkward(seed=0):
    """Null, empty, blank, one word, repeated rows, accents, astral letters, a long run, a long text."""
    long_ = prose(30_000, seed)
    return [None, "", " \n\t ", "Word", "Word", "é" * 50 + " Ünïcode 𝒳𝒴 straße", "x" * 50_000, "a " * 5000, long_, long_, prose(200, seed + 1), prose(200, seed + 2)]
