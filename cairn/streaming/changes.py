"""Change streams: the latest state of each path, kept by Structured Streaming, and counts by kind.

Both work on a streaming table (path, event, seq) and on a static one.  The state of a path is one row; the
store is partitioned by path, so it grows with the paths, not with the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of change, and what a path is after each.
EVENTS = {"add": "indexed", "change": "indexed", "unlink": "missing", "read-error": "read-error"}


def read_changes(spark: SparkSession, folder: str, schema: str, files: str = "*.parquet", per_trigger: int = 64) -> DataFrame:
    """A stream over the Parquet files of a change-log folder, a bounded number at a time."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def latest(changes: DataFrame) -> DataFrame:
    """A streaming table of each touched path's newest event and how many were applied; update mode."""
    newest = F.max(F.struct("seq", "event")).alias("newest")
    return changes.groupBy("path").agg(newest, F.count("*").alias("applied")).select("path", "newest.seq", "newest.event", "applied")


def counts(changes: DataFrame, *by: str) -> DataFrame:
    return changes.groupBy(*by).agg(F.count("*").alias("n"))


def drain(stream: DataFrame, folder: str, mode: str, key: list[str], newest: str | None) -> DataFrame:
    """Runs a streaming table over all that is there now, into ``folder``, and returns its final rows.

    Each micro-batch is written under its number, so a repeated one replaces itself; of an updated key the row of
    the last batch counts.  State and progress are in ``folder`` too: a later call takes up where this one ended.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number:012d}")

    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("batch", *([newest] if newest else []))).alias("r"))
    return last.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])
