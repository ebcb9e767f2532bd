"""Run-length encoding of a cleaned timeline into score states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .smoothing import CORE


def state_runs(cleaned: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """One row for each run of equal core values: match_id, state_id, innings, core, batter, start, end, n_samples, mean_confidence, start_confidence.

    Rows with a null in the core are left out before runs are formed; a value that returns is a new state.
    mean_confidence is the mean ocr_confidence of the run's readings, 0 if there is none, and start_confidence the lesser
    of the two confidences of its first reading. Cleaned rows without confidences take those of the raw readings at their times.
    """
    rows = cleaned.dropna(subset=list(CORE))
    if "ocr_confidence" in rows.columns:
        rows = rows.withColumns({"confidence": F.col("ocr_confidence"), "lesser": F.least("ocr_confidence", "parse_confidence")})
    elif raw is not None:
        lesser = F.max_by(F.least("ocr_confidence", "parse_confidence"), "reading_id")
        latest = raw.groupBy("match_id", "timestamp_seconds").agg(F.max_by("ocr_confidence", "reading_id").alias("confidence"), lesser.alias("lesser"))
        rows = rows.join(latest, ["match_id", "timestamp_seconds"], "left")
    else:
        rows = rows.withColumns({"confidence": F.lit(None).cast("double"), "lesser": F.lit(None).cast("double")})
    order = Window.partitionBy("match_id").orderBy("timestamp_seconds", "reading_id")
    now = F.struct(*CORE)
    changed = (~now.eqNullSafe(F.lag(now).over(order))).cast("int")
    rows = rows.withColumn("__changed", changed)
    rows = rows.withColumn("state_id", F.sum("__changed").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    first = F.struct("timestamp_seconds", "reading_id")
    return rows.groupBy("match_id", "state_id").agg(
        F.min_by("innings", first).alias("innings"),
        *(F.min_by(c, first).alias(c) for c in (*CORE, "batter")),
        F.min("timestamp_seconds").alias("start_seconds"),
        F.max("timestamp_seconds").alias("end_seconds"),
        F.count("*").alias("n_samples"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
        F.min_by("lesser", first).alias("start_confidence"),
    )
