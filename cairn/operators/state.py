"""Keeping a file table current: outcomes over a base, the dirty overlay, freshness, generations, diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.paths import canonical_path
from cairn.operators.ordered import running

# Default bounds, and the mark of a removed path.
RETENTION, QUOTA_BYTES = 3, 128 * 1024 * 1024
MAX_ERRORS, MAX_WARNINGS = 32, 128
DELETED = "deleted"


def last_events(events: DataFrame, order: list[str]) -> DataFrame:
    """The newest event of each path, by ``order`` (which must decide ties); combined before the shuffle."""
    rest = [c for c in events.columns if c != "path"]
    newest = events.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e"))
    return newest.select("path", *[F.col(f"e.{c}").alias(c) for c in rest])


def apply_outcomes(base: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``path, hash, dirty, pending`` after outcomes (path, outcome, hash) met the base (path, hash).

    ``hash`` is the effective content (null: no row), ``dirty`` the overlay's entry (null: none).  Paths without
    an outcome keep their base content.  An ``unlink`` counts as an outcome here.
    """
    b = base.select("path", F.col("hash").alias("_base"))
    o = outcomes.select("path", "outcome", F.col("hash").alias("_new"))
    row = b.join(o, "path", "full_outer")
    known = F.col("_base").isNotNull()
    kind = F.col("outcome")
    effective = F.when(kind.isNull() | (kind == "read-error"), F.col("_base")).when(kind == "indexed", F.col("_new"))
    special = F.sha2(F.concat(F.lit("non-regular\x00"), "path").cast("binary"), 256)
    dirty = (
        F.when(kind == "indexed", F.when(~F.col("_new").eqNullSafe(F.col("_base")), F.col("_new")))
        .when(kind.isin("missing", "unlink") & known, F.lit(DELETED)).when((kind == "non-text") & known, F.col("_new")).when((kind == "non-regular") & known, special)
    )
    return row.select("path", effective.alias("hash"), dirty.alias("dirty"), F.coalesce(kind == "read-error", F.lit(False)).alias("pending"))


def reconcile(overlay: DataFrame, status: DataFrame, failures: DataFrame) -> DataFrame:
    """The overlay (path, hash) after a listing of dirty paths (path, hash, tracked).

    A path stays dirty only if it is listed; one whose reading failed keeps its earlier entry.  Untracked paths
    without content (null hash) never become dirty.
    """
    listed = status.select("path", F.col("hash").alias("_now"), "tracked", F.lit(True).alias("_listed"))
    failed = failures.select("path").distinct().withColumn("_failed", F.lit(True))
    row = overlay.select("path", F.col("hash").alias("_had")).join(listed, "path", "full_outer").join(failed, "path", "full_outer")
    now = F.when(F.col("_listed") & (F.col("tracked") | F.col("_now").isNotNull()), F.coalesce("_now", F.lit(DELETED)))
    return row.select("path", F.when(F.col("_failed"), F.col("_had")).otherwise(now).alias("hash")).where(F.col("hash").isNotNull())


def freshness(failed, pending, queued, read_errors, degraded, dirty) -> Column:
    """stale before unsupported before dirty before fresh; counts or flags as columns."""
    some = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("long") > 0
    return F.when(some(failed) | some(pending) | some(queued) | some(read_errors), "stale").when(some(degraded), "unsupported").when(some(dirty), "dirty").otherwise("fresh")


def revision(head: str, overlay: DataFrame) -> DataFrame:
    """One row: the workspace revision, sha256 over the head and the dirty entries (path, hash) in path order, NUL between.

    The entries are sorted by ranges and joined in their tasks; the driver digests one task's bytes after the other, so
    it holds no more than those.
    """
    import hashlib

    def joined(batches):
        for batch in batches:
            yield batch.groupby(lambda _: 0)["entry"].apply(lambda e: "".join(e).encode()).to_frame("bytes")

    entry = F.concat(F.lit("\x00"), "path", F.lit("\x00"), "hash").alias("entry")
    ordered = overlay.where(F.col("hash").isNotNull()).select("path", "hash").orderBy("path").select(entry)
    digest = hashlib.sha256(head.encode())
    for row in ordered.mapInPandas(joined, "bytes binary").toLocalIterator():
        digest.update(row["bytes"])
    return overlay.sparkSession.createDataFrame([(digest.hexdigest(),)], "revision string")


def content_identity(files: DataFrame, *columns: str) -> str:
    """Order-independent digest of rows: sha256 per row, summed modulo 2^256 in four exact parts on the cluster."""
    h = F.sha2(F.to_json(F.struct(*(columns or files.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(8)]
    row = files.agg(F.count("*").alias("n"), *parts).first()
    import hashlib

    return hashlib.sha256(repr([row["n"], *[int(row[f"p{i}"] or 0) for i in range(8)]]).encode()).hexdigest()


def pruned(generations: DataFrame, active: int, retention: int = RETENTION, quota: int = QUOTA_BYTES) -> DataFrame:
    """``generations`` (generation, bytes) plus ``kept``: oldest below the active one go until at most ``retention``
    stay, then until all bytes are within ``quota``; the active and newer ones always stay."""
    out = running(generations.select("generation", "bytes"), [F.col("generation").desc()], {"place": "1L", "total": "bytes"})
    return out.select("generation", "bytes", ((F.col("generation") >= active) | ((F.col("place") <= retention) & (F.col("total") <= quota))).alias("kept"))


# Diagnostics.
MESSAGES = {"parse": "file could not be parsed", "read": "file could not be read", "runtime": "maintenance failed"}
KEYS = ["severity", "code", "phase", "path", "message"]


def diagnostics(warnings: DataFrame) -> DataFrame:
    """Warnings (path, code) as collapsed diagnostics: equal ones of one canonical path are counted."""
    read = F.col("code") == "read-error"
    run = F.col("code") == "runtime-error"
    rows = warnings.select(
        F.when(read | run, "error").otherwise("warning").alias("severity"), "code", F.when(run, "runtime").when(read, "indexing").otherwise("analyzer").alias("phase"),
        canonical_path("path").alias("path"), F.when(run, MESSAGES["runtime"]).when(read, MESSAGES["read"]).otherwise(MESSAGES["parse"]).alias("message"),
    )
    return rows.groupBy(*KEYS).agg(F.count("*").alias("occurrenceCount"))


def bounded(rows: DataFrame, errors: int = MAX_ERRORS, warnings: int = MAX_WARNINGS) -> DataFrame:
    """The first diagnostics of each severity in order; where some are cut the last place says how many."""
    order = ["code", F.col("path").asc_nulls_first(), "phase", "message"]
    out = []
    for severity, most in (("error", errors), ("warning", warnings)):
        mine = rows.where(F.col("severity") == severity)
        n = mine.agg(F.count("*").alias("n"))
        first = mine.orderBy(*order).limit(most).withColumn("omittedCount", F.lit(None).cast("long"))
        if mine.limit(most + 1).count() <= most:
            out.append(first)
            continue
        over = n.select(
            F.lit(severity).alias("severity"), F.lit("diagnostics-truncated").alias("code"), F.lit("snapshot").alias("phase"), F.lit(None).cast("string").alias("path"),
            F.lit("further diagnostics were omitted").alias("message"), F.lit(1).cast("long").alias("occurrenceCount"), (F.col("n") - (most - 1)).alias("omittedCount"),
        )
        out.append(mine.orderBy(*order).limit(most - 1).withColumn("omittedCount", F.lit(None).cast("long")).unionByName(over))
    return reduce(DataFrame.unionByName, out)


# Telemetry: counters are named conditions, summed in one pass.


def counters(events: DataFrame, conditions: dict[str, str], by: list[str] | None = None) -> DataFrame:
    sums = [F.sum(F.expr(c).cast("long")).alias(k) for k, c in conditions.items()]
    return events.groupBy(*by).agg(*sums) if by else events.agg(*[F.coalesce(s, F.lit(0)).alias(k) for s, k in zip(sums, conditions, strict=True)])
