"""Consensus smoothing of a timeline: outlier removal by neighbours, then hold-forward."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CORE = ("over_number", "ball_in_over", "runs", "wickets")


def unusable() -> Column:
    return (F.col("ocr_confidence") == 0) | (F.col("parse_confidence") == 0)


def resolve(readings: DataFrame, window: int = 2, core: tuple[str, ...] = CORE) -> DataFrame:
    """Add resolution: unusable, outlier or passed.

    Among the usable readings of a match, one with ``window`` others on each side is an outlier if all of those agree
    on the core and it differs from them; nulls agree with nulls.
    """
    own = F.struct(*core)
    order = Window.partitionBy("match_id", "__unusable").orderBy("timestamp_seconds", "reading_id")
    near = [f(F.col("__core"), k).over(order) for k in range(1, window + 1) for f in (F.lag, F.lead)]
    rows = readings.withColumn("__unusable", unusable()).withColumn("__core", own)
    alike = reduce(and_, (n.isNotNull() & n.eqNullSafe(near[0]) for n in near))
    outlier = alike & ~F.col("__core").eqNullSafe(near[0])
    resolution = F.when(F.col("__unusable"), "unusable").when(outlier, "outlier").otherwise("passed")
    return rows.withColumn("resolution", resolution).drop("__unusable", "__core")


def hold_forward(resolved: DataFrame, fields: tuple[str, ...] = (*CORE, "batter"), core: tuple[str, ...] = CORE) -> DataFrame:
    """Cleaned rows: passed readings as they are, others with the last passed one whose core is complete, or nulls.

    Confidences stay those of the reading itself.
    """
    complete = reduce(and_, (F.col(c).isNotNull() for c in core))
    order = Window.partitionBy("match_id").orderBy("timestamp_seconds", "reading_id").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when((F.col("resolution") == "passed") & complete, F.struct(*fields)), ignorenulls=True).over(order)
    rows = resolved.withColumn("__held", held)
    values = [F.when(F.col("resolution") == "passed", F.col(c)).otherwise(F.col(f"__held.{c}")).alias(c) for c in fields]
    own = [c for c in ("ocr_confidence", "parse_confidence") if c in rows.columns]
    return rows.select("match_id", "innings", "timestamp_seconds", "reading_id", *values, "resolution", *own)


def smooth(readings: DataFrame, window: int = 2) -> DataFrame:
    return hold_forward(resolve(readings, window))


def smoothing_stats(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("match_id", "resolution").agg(F.count("*").alias("n"))
