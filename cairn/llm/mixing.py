"""Mixing sources to target weights by a time-varying curriculum (DataFrame operations only).

Each source has a weight schedule over training time t in [0, 1].  Its integral says which share of the
source's tokens training has asked for by time t.  Documents of a source are laid end to end on an axis of
cumulative tokens in a pseudo-random but repeatable order; inverting the integral turns a document's place
on that axis into the time at which it is read, and a range sort by that time gives the training order.

Scale.  Cumulative sums never put a source into one task: rows are cut by their order key into fine buckets
(about ``ROWS_A_BUCKET`` rows of all sources each), only bucket totals are summed along a source, in two
levels, and each row then needs only its own bucket.  One source may hold any share of the rows.

Defined results: null text has size 0; null source is a source of its own, last in order; a null doc_id is
ordered by its size alone; rows that agree in doc_id and size are interchangeable; an empty table gives an
empty result; documents without words are never taken.  Extra columns pass through unchanged, but for those that
bear the name of a column that the mix adds, which replace them; work columns start with ``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import checkpoint, table, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: Slopes of the schedules, repeating: early, level, late.  The weight at time t is weight * (1 + slope * (2t - 1)).
SLOPES = (-0.5, 0.0, 0.5)
MAX_REPEATS = 3
ROWS_A_BUCKET = 256
FINE_A_COARSE = 1024


def n_words(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def _cyclic(rank: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row a source: ``_mix_source, source_size, target, _mix_slope``.

    ``sizes`` has ``source`` and ``size``.  Targets are the least level L at which sum(min(cap, L * weight))
    reaches all words; with caps sorted by cap / weight, the level after the first k are capped is
    (all - their caps) / (weights of the rest), and the first source whose own ratio is not below it ends the search.
    The table has one row a source, so its global windows are small.
    """
    by_name = Window.orderBy(F.col("_mix_source").asc_nulls_last())
    by_ratio = Window.orderBy("_mix_ratio", "_mix_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = sizes.groupBy(F.col("source").alias("_mix_source")).agg(F.sum("size").alias("source_size"))
    t = t.withColumn("_mix_rank", F.row_number().over(by_name))
    t = t.withColumn("_mix_weight", _cyclic(F.col("_mix_rank"), WEIGHTS)).withColumn("_mix_slope", _cyclic(F.col("_mix_rank"), SLOPES))
    t = t.withColumn("_mix_cap", F.col("source_size").cast("double") * MAX_REPEATS)
    t = t.withColumn("_mix_ratio", F.col("_mix_cap") / F.col("_mix_weight"))
    t = t.withColumn("_mix_left", F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("_mix_cap").over(before), F.lit(0.0)))
    t = t.withColumn("_mix_share", F.sum("_mix_weight").over(every) - F.coalesce(F.sum("_mix_weight").over(before), F.lit(0.0)))
    t = t.withColumn("_mix_level", F.col("_mix_left") / F.col("_mix_share"))
    t = t.withColumn("_mix_level", F.min(F.when(F.col("_mix_ratio") >= F.col("_mix_level"), F.struct("_mix_ratio", "_mix_rank", "_mix_level"))).over(every)["_mix_level"])
    return t.select("_mix_source", "source_size", F.when(F.col("_mix_level").isNull(), F.col("_mix_cap")).otherwise(F.least(F.col("_mix_cap"), F.col("_mix_level") * F.col("_mix_weight"))).alias("target"), "_mix_slope")


def schedule_inverse(share: Column, slope: Column) -> Column:
    """The time t at which t + slope * (t * t - t) = share."""
    return F.lit(2.0) * share / ((F.lit(1.0) - slope) + F.sqrt((F.lit(1.0) - slope) * (F.lit(1.0) - slope) + F.lit(4.0) * slope * share))


def mix_sources(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``docs`` plus ``source_size, target, taken, position``.

    ``docs`` has ``doc_id, source`` and ``size`` (words) and any other columns; ``sizes`` holds the same rows'
    ``doc_id, source, size`` and is read several times, so pass a checkpointed or stored table.  ``taken`` counts
    repeats: a document is read once for every pass r < 3 over its source in which the middle of its words lies
    below the target; ``position`` is the time of its first reading (null if it is never read).
    """
    docs = docs.drop("source_size", "target", "taken", "position")
    n = sizes.count()
    fine = max(1, -(-n // ROWS_A_BUCKET))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")).cast("binary"))
    bucket = F.floor(F.conv(F.substring(F.col("_mix_key"), 1, 8), 16, 10).cast("double") * fine / float(2**32)).cast("long")
    keyed = lambda df: df.withColumn("_mix_key", key).withColumn("_mix_bucket", bucket)

    targets = source_targets(sizes)
    totals = keyed(sizes).groupBy(F.col("source").alias("_mix_source"), F.col("_mix_bucket").alias("_mix_fine")).agg(F.sum("size").alias("_mix_total"))
    totals = totals.withColumn("_mix_coarse", F.floor(F.col("_mix_fine") / FINE_A_COARSE))
    within = Window.partitionBy("_mix_source", "_mix_coarse").orderBy("_mix_fine").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_mix_within", F.coalesce(F.sum("_mix_total").over(within), F.lit(0)))
    coarse = totals.groupBy(F.col("_mix_source").alias("_mix_s2"), F.col("_mix_coarse").alias("_mix_c2")).agg(F.sum("_mix_total").alias("_mix_ctotal"))
    along = Window.partitionBy("_mix_s2").orderBy("_mix_c2").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("_mix_base", F.coalesce(F.sum("_mix_ctotal").over(along), F.lit(0)))
    starts = totals.join(coarse, totals["_mix_source"].eqNullSafe(coarse["_mix_s2"]) & (totals["_mix_coarse"] == coarse["_mix_c2"]))
    starts = starts.select("_mix_source", "_mix_fine", (F.col("_mix_base") + F.col("_mix_within")).alias("_mix_start"))
    targets = targets.withColumnRenamed("_mix_source", "_mix_s3")
    starts = starts.join(targets, starts["_mix_source"].eqNullSafe(targets["_mix_s3"])).drop("_mix_s3")

    rows = keyed(docs)
    mine = Window.partitionBy("source", "_mix_bucket").orderBy("_mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_mix_mine", F.coalesce(F.sum("size").over(mine), F.lit(0)))
    rows = rows.join(starts, rows["source"].eqNullSafe(starts["_mix_source"]) & (rows["_mix_bucket"] == starts["_mix_fine"]))
    middle = F.col("_mix_start").cast("double") + F.col("_mix_mine").cast("double") + F.col("size").cast("double") / 2.0
    rows = rows.withColumn("_mix_middle", middle)
    passes = sum(((F.col("_mix_middle") + F.col("source_size").cast("double") * r) < F.col("target")).cast("long") for r in range(MAX_REPEATS))
    rows = rows.withColumn("taken", F.when(F.col("size") > 0, F.col("size") * passes).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, schedule_inverse(F.col("_mix_middle") / F.col("target"), F.col("_mix_slope"))))
    return rows


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each reading of a document, range-sorted by ``position`` (``reading`` counts from 1)."""
    out = mixed.drop("reading").where(F.col("taken") > 0).withColumn("reading", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))))
    share = (F.col("_mix_middle") + F.col("source_size").cast("double") * (F.col("reading") - 1)) / F.col("target")
    out = out.withColumn("position", schedule_inverse(share, F.col("_mix_slope")))
    out = out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return out.drop(*[c for c in out.columns if c.startswith("_mix_")])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract of op9 over all of ``documents``; ``position`` (time of the first reading) follows."""
    sizes = checkpoint(table(spark, sf_dir, "documents", "doc_id", "source", "text").select("doc_id", "source", n_words().alias("size")))
    out = mix_sources(sizes, sizes).select("doc_id", "size", "source_size", "target", "taken", "position")
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM d GROUP BY source),
w AS (
  SELECT *, CAST((rk - 1) % 3 + 1 AS DOUBLE) AS weight, (ARRAY[-0.5, 0.0, 0.5])[(rk - 1) % 3 + 1]::DOUBLE AS slope,
         CAST(source_size AS DOUBLE) * 3 AS cap FROM s),
r AS (
  SELECT *, cap / weight AS ratio,
         CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0.0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0) AS share
  FROM w WINDOW b AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(rest / share, (ratio, rk)) AS level FROM r WHERE ratio >= rest / share),
t AS (SELECT source, source_size, slope, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM r, l),
o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || CAST(d.size AS VARCHAR)), d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) + CAST(d.size AS DOUBLE) / 2.0 AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, CASE WHEN size > 0 THEN size * (CAST(middle < target AS BIGINT) + CAST(middle + CAST(source_size AS DOUBLE) < target AS BIGINT)
                                       + CAST(middle + CAST(source_size AS DOUBLE) * 2 < target AS BIGINT)) ELSE 0 END AS taken FROM o)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN 2.0::DOUBLE * (middle / target) / ((1.0::DOUBLE - slope) + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4.0::DOUBLE * slope * (middle / target))) END AS position
FROM k
"""
