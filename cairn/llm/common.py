"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of one Arrow batch, beside Spark's limit of rows: memory then doesn't follow the longest texts.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one Parquet table through Spark (any path Spark can read), keeping only ``columns``."""
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder that the cluster names.

    The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset a folder is chosen
    here: a temporary one in local mode, else one below the (shared) warehouse.  What the cut lineage held
    (shuffle files, plans, broadcasts) is let go at once rather than when the driver's heap happens to fill.
    """
    spark = df.sparkSession
    bound_batches(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        conf = sc.getConf()
        named = conf.get("spark.checkpoint.dir", "")
        if not named:
            local = sc.master.startswith("local[") or sc.master == "local"
            named = tempfile.mkdtemp(prefix="cairn-checkpoint-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(named)
    out = df.checkpoint(eager=True)
    spark._jvm.System.gc()
    return out


def compact(df: DataFrame, rows: int, rows_a_part: int = 50_000) -> DataFrame:
    """Narrow rows in as many partitions as ``rows`` of them are worth, so that later shuffles write few files."""
    return df.coalesce(max(8, -(-rows // rows_a_part)))


def text_or_empty(column: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str = "doc_id", parts: int = 4) -> Column:
    """crc32 of the id as text modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


#: A-Z and their lower-case forms: the only letters that the contracts fold.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only; every code point keeps its place."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def spans_digest(spans: list[tuple[int, int, str]], order: dict[str, int]) -> str:
    """``kind:start:end`` joined by commas, by start and then by the kind's rank."""
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], order[x[2]], x[1])))
