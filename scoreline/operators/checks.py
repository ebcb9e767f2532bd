"""Checks of inputs and figures of a run, each one aggregation by match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .report import long_format
from .smoothing import CORE, unusable

BOUNDARY_TYPES = ("ORDINARY_CUT", "REPLAY_TRANSITION")


def reading_checks(readings: DataFrame) -> DataFrame:
    """match_id, metric, value: readings in all, without a time, not after the one before, with a null in the core, with a confidence outside 0 to 1."""
    order = Window.partitionBy("match_id").orderBy("reading_id")
    core = F.coalesce(*(F.when(F.col(c).isNull(), True) for c in CORE), F.lit(False))
    outside = F.coalesce(~F.col("ocr_confidence").between(0, 1), F.lit(True)) | F.coalesce(~F.col("parse_confidence").between(0, 1), F.lit(True))
    rows = readings.withColumn("__before", F.lag("timestamp_seconds").over(order))
    counted = rows.groupBy("match_id").agg(
        F.count("*").alias("readings"),
        F.count_if(F.col("timestamp_seconds").isNull()).alias("without_time"),
        F.count_if(F.col("timestamp_seconds") <= F.col("__before")).alias("out_of_order"),
        F.count_if(core).alias("incomplete"),
        F.count_if(outside).alias("bad_confidence"),
    )
    return long_format(counted, ["match_id"])


def bad_boundaries(boundaries: DataFrame) -> DataFrame:
    """Boundaries without a finite time, of an unknown type, or with a confidence outside 0 to 1."""
    time = F.col("timestamp_seconds")
    fine = time.isNotNull() & ~F.isnan(time) & (F.abs(time) != float("inf")) & F.col("boundary_type").isin(*BOUNDARY_TYPES) & F.col("confidence").between(0, 1)
    return boundaries.filter(~F.coalesce(fine, F.lit(False)))


def reading_figures(least_confidence: float = 0.5) -> list[Column]:
    """Readings, undetectable ones, ones of low confidence, rejected by the parser, unusable ones, and the two mean confidences.

    A reading without any core value is undetectable; it counts under nothing else but the means.
    """
    seen = F.coalesce(*CORE).isNotNull()
    return [
        F.count("*").alias("n_readings"),
        F.count_if(~seen).alias("undetectable"),
        F.count_if(seen & (F.col("ocr_confidence") < least_confidence)).alias("low_confidence"),
        F.count_if(seen & (F.col("parse_confidence") == 0)).alias("rejected"),
        F.count_if(unusable()).alias("unusable"),
        F.avg("ocr_confidence").alias("mean_ocr_confidence"),
        F.avg("parse_confidence").alias("mean_parse_confidence"),
    ]


def smoothing_figures() -> list[Column]:
    return [F.count_if(F.col("resolution") == kind).alias(f"n_{kind}") for kind in ("passed", "outlier", "unusable")]


def event_figures() -> list[Column]:
    """Events of each type, events in replays, and the mean confidence."""
    kinds = [F.count_if(F.col("event_type") == k).alias(f"n_{k.lower()}") for k in ("FOUR", "SIX", "WICKET", "TEAM_MILESTONE")]
    return [*kinds, F.count_if(F.coalesce("is_replay", F.lit(False))).alias("n_replays"), F.avg("confidence").alias("mean_confidence")]


def reading_stats(readings: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    return readings.groupBy("match_id").agg(*reading_figures(least_confidence))


def event_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("match_id").agg(*event_figures())


def counts_by(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """match_id, metric (prefix and value), n: how many rows a match has of each value; nulls are left out."""
    return rows.filter(F.col(column).isNotNull()).groupBy("match_id", F.concat(F.lit(prefix), column).alias("metric")).agg(F.count("*").alias("n"))
