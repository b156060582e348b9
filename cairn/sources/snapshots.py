"""Snapshots of a file table as JSON documents with a version, and checkpoints that carry their trust."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import schema
from cairn.functions.paths import canonical_path, path_collisions
from cairn.operators import state

VERSION = 1
FRESHNESS = ("fresh", "dirty", "stale", "unsupported")


def write(files: DataFrame, folder: str) -> None:
    """One JSON document a file, each with the version."""
    files.withColumn("schemaVersion", F.lit(VERSION)).write.mode("overwrite").json(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The file table of a snapshot; a damaged row or another version is an error."""
    rows = spark.read.schema(schema.FILES + ", schemaVersion int").option("mode", "FAILFAST").json(folder)
    wrong = rows.where(~F.col("schemaVersion").eqNullSafe(F.lit(VERSION))).limit(1).count()
    if wrong:
        raise ValueError(f"snapshot in {folder} isn't of version {VERSION}")
    return rows.drop("schemaVersion")


@dataclass
class Checkpoint:
    """What was known at one moment: files and, apart from their identity, how far they can be trusted."""

    files: DataFrame
    identity: str
    generation: int
    head: str = "no-head"
    revision: str = ""
    freshness: str = "fresh"
    dirty: DataFrame | None = None
    pending: list[str] = field(default_factory=list)
    diagnostics: DataFrame | None = None


class CheckpointError(ValueError):
    pass


def checkpoint(files: DataFrame, generation: int, warnings: DataFrame | None = None, dirty: DataFrame | None = None, head: str = "no-head", freshness: str = "fresh", pending=()) -> Checkpoint:
    """A validated checkpoint: canonical paths, known freshness, no two spellings of a path, hashes in form.

    The identity is of the files alone; head, freshness, dirty and pending paths don't change it.
    """
    if freshness not in FRESHNESS:
        raise CheckpointError(f"unknown freshness {freshness}")
    clean = files.withColumn("_raw", F.col("path")).withColumn("path", canonical_path("path"))
    bad = clean.agg(F.count_if(F.col("path").isNull()).alias("paths"), F.count_if(~F.col("contentHash").rlike("^[0-9a-f]{64}$")).alias("hashes")).first()
    if bad["paths"] or bad["hashes"]:
        raise CheckpointError(f"{bad['paths']} paths and {bad['hashes']} hashes aren't canonical")
    if path_collisions(clean, "_raw").limit(1).count() or clean.groupBy("path").count().where("count > 1").limit(1).count():
        raise CheckpointError("two rows have one canonical path")
    clean = clean.drop("_raw")
    if dirty is not None:
        dirty = dirty.select(canonical_path("path").alias("path"), "hash")
        if dirty.where(F.col("path").isNull() | ~F.col("hash").rlike("^([0-9a-f]{64}|deleted)$")).limit(1).count():
            raise CheckpointError("a dirty entry isn't canonical")
        if dirty.groupBy("path").agg(F.count_distinct("hash").alias("n")).where("n > 1").limit(1).count():
            raise CheckpointError("a dirty path has two hashes")
        dirty = dirty.distinct()
    revision = state.revision(head, dirty).first()[0] if dirty is not None else ""
    found = state.bounded(state.diagnostics(warnings)) if warnings is not None else None
    return Checkpoint(clean, "sha256:" + state.content_identity(clean, "path", "contentHash", "kind", "language"), generation, head, revision, freshness, dirty, sorted(set(pending)), found)


class Provider:
    """Holds the last good checkpoint; a failed publication keeps it and marks it stale."""

    def __init__(self):
        self._last: Checkpoint | None = None

    def publish(self, **facts) -> Checkpoint:
        try:
            self._last = checkpoint(**facts)
        except CheckpointError:
            if self._last is None:
                raise
            self._last.freshness = "stale"
        return self._last

    def current(self) -> Checkpoint:
        if self._last is None:
            raise CheckpointError("nothing was published yet")
        return self._last
