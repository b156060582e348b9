"""Live results: pending, indexed and component rows merged by priority, evidence attached, payload bounded."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.scan import utf8_prefix


def first_wins(parts: list[DataFrame], key: str = "path", order: str = "rank") -> DataFrame:
    """The union of ``parts`` in their order of priority; the first row of each key stays, with its ``priority``."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("priority", F.lit(i)) for i, p in enumerate(parts)])
    place = Window.partitionBy(key).orderBy("priority", order)
    return rows.withColumn("_place", F.row_number().over(place)).where(F.col("_place") == 1).drop("_place")


def live_merge(exact: DataFrame, indexed: DataFrame, component: DataFrame, contradicted: DataFrame, limit: int) -> DataFrame:
    """Exact pending rows, then indexed rows that no finished read contradicts (a pending component row in their
    place where there is one), then other component rows; all have ``path, rank, score``."""
    override = component.select("path", F.struct("rank", "score").alias("_c"))
    kept = indexed.join(contradicted.select("path").distinct(), "path", "left_anti").join(override, "path", "left")
    kept = kept.select("path", "rank", F.coalesce("_c.score", "score").alias("score"))
    shape = lambda df: df.select("path", "rank", "score")
    out = first_wins([shape(exact), kept, shape(component)])
    return out.orderBy("priority", "rank", "path").limit(limit)


def with_evidence(results: DataFrame, pending: DataFrame, indexed: DataFrame) -> DataFrame:
    """``results`` plus ``excerpt`` and ``evidence``: pending evidence (path, excerpt) before indexed."""
    p = pending.dropDuplicates(["path"]).select("path", F.struct(F.lit("pending").alias("evidence"), "excerpt").alias("_p"))
    i = indexed.dropDuplicates(["path"]).select("path", F.struct(F.lit("indexed").alias("evidence"), "excerpt").alias("_i"))
    row = results.join(p, "path", "left").join(i, "path", "left").withColumn("_e", F.coalesce("_p", "_i"))
    return row.select(*results.columns, F.col("_e.excerpt").alias("excerpt"), F.col("_e.evidence").alias("evidence"))


# Bytes of a payload.
LEAST_PAYLOAD, DEFAULT_PAYLOAD = 512, 6144


def _size(payload: dict) -> int:
    return len(json.dumps(payload, ensure_ascii=False, separators=(",", ":")).encode())


def bound_payload(payload: dict, most: int = DEFAULT_PAYLOAD) -> str:
    """JSON of at most ``most`` bytes, with results and their evidence dropped together.

    Sheds in order: the diff and pending paths from the end; query, error, revision and head down to 8 bytes; results from the
    end with their evidence, down to one; the top excerpt down to 32 bytes; evidence with its result; the rest.
    Pretty-printed if that fits.  Shed fields are named in ``truncatedFields``.
    """
    if most < LEAST_PAYLOAD:
        raise ValueError(f"a payload needs {LEAST_PAYLOAD} bytes or more")
    p = json.loads(json.dumps(payload))
    shed: list[str] = []

    def note(name: str) -> None:
        if name not in shed:
            shed.append(name)
        p["truncatedFields"] = shed

    fits = lambda: _size(p) <= most
    while not fits() and p.get("diff"):
        p["diff"] = utf8_prefix(p["diff"], max(0, len(p["diff"].encode()) - max(64, _size(p) - most)))
        note("diff")
    while not fits() and p.get("pendingPaths"):
        p["pendingPaths"].pop()
        note("pendingPaths")
    for name in ("query", "error", "revision", "head"):
        while not fits() and isinstance(p.get(name), str) and len(p[name].encode()) > 8:
            p[name] = utf8_prefix(p[name], max(8, len(p[name].encode()) - max(1, _size(p) - most)))
            note(name)
    results, evidence = p.setdefault("results", []), p.setdefault("evidence", [])

    def drop_last() -> None:
        path = results.pop().get("path")
        evidence[:] = [e for e in evidence if e.get("path") != path]
        note("results")

    while not fits() and len(results) > 1:
        drop_last()
    if evidence and not fits():
        text = evidence[0].get("excerpt", "")
        while not fits() and len(text.encode()) > 32:
            text = utf8_prefix(text, max(32, len(text.encode()) - max(1, _size(p) - most)))
            evidence[0]["excerpt"] = text
            note("excerpt")
    while not fits() and evidence:
        path = evidence.pop().get("path")
        results[:] = [r for r in results if r.get("path") != path]
        note("evidence")
    while not fits() and results:
        drop_last()
    if not fits():
        p["query"] = ""
        note("query")
    pretty = json.dumps(p, ensure_ascii=False, indent=2)
    return pretty if len(pretty.encode()) <= most else json.dumps(p, ensure_ascii=False, separators=(",", ":"))
