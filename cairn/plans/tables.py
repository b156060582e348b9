"""The driver's tables as the engine's inputs: documents as virtual files, events as changes, names as symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import schema
from cairn.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_path():
    return F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, text`` of documents."""
    return table(spark, sf_dir, "documents").select(document_path().alias("path"), "text")


def files(spark: SparkSession, sf_dir: str, terms: int = T.MAX_TERMS) -> DataFrame:
    """Documents as a file table, with at most ``terms`` terms each."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        document_path().alias("path"), F.lit("lexical").alias("kind"), F.lit("text").alias("language"), F.sha2(text.cast("binary"), 256).alias("contentHash"),
        F.octet_length(text).cast("long").alias("sizeBytes"), T.lexical_terms(document_path(), text, terms).alias("lexicalTerms"), none(schema.IMPORT).alias("imports"),
        none(schema.EXPORT).alias("exports"), none(schema.SYMBOL).alias("symbols"), none("string").alias("dependencies"), F.lit(None).cast("string").alias("packageName"),
        F.lit(None).cast("string").alias("degradedReason"),
    )


#: What each kind of event means as a change of a path.
EVENT_KINDS = {"click": "change", "view": "change", "signup": "add", "purchase": "unlink", "error": "read-error"}


def changes(events: DataFrame) -> DataFrame:
    """``path, event, seq, ts`` of an events table; ``seq`` is a total order."""
    kind = F.create_map(*[F.lit(x) for kv in EVENT_KINDS.items() for x in kv])[F.col("event_type")]
    return events.select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), kind.alias("event"), F.col("event_id").alias("seq"), "ts", "event_id")
