"""Cutting lineage where a plan would otherwise be computed, or planned, again and again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints (``spark.checkpoint.dir``), set in the session if it isn't yet.

    Where that is unset: a temporary folder in local mode, else one below the warehouse, which is shared too.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", "")
        if not named:
            local = sc.master == "local" or sc.master.startswith("local[")
            named = tempfile.mkdtemp(prefix="cairn-checkpoint-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table below the shared folder: readers take the columns that they need."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
