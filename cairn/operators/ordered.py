"""Running totals along a global order without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.materialise import materialise


def running(df: DataFrame, order: list, totals: dict[str, str], partitions: int | None = None) -> DataFrame:
    """``df`` plus, for each ``name: expression`` of ``totals``, the sum of the expression up to and with the row.

    Rows are range-partitioned by ``order``; only the partitions' sums are put in line (one row a partition) and
    joined back, so each task sums its own range.  ``order`` should decide all ties.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(n, *order).withColumn("_run_part", F.spark_partition_id()))
    sums = dealt.groupBy("_run_part").agg(*[F.sum(F.expr(e)).alias(f"_run_{k}") for k, e in totals.items()])
    before = Window.orderBy("_run_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_run_part", *[F.coalesce(F.sum(f"_run_{k}").over(before), F.lit(0)).alias(f"_run_{k}") for k in totals])
    mine = Window.partitionBy("_run_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(sums), "_run_part")
    for k, e in totals.items():
        out = out.withColumn(k, F.col(f"_run_{k}") + F.sum(F.expr(e)).over(mine))
    return out.drop("_run_part", *[f"_run_{k}" for k in totals])
