"""Which frames of a recording to read: plans over (match_id, frame_count, fps), before any pixel is decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.folds import fold_rows


def every_frame(videos: DataFrame) -> DataFrame:
    return videos.filter("frame_count > 0").select("match_id", F.explode(F.sequence(F.lit(0), F.col("frame_count") - 1)).alias("frame_index"))


def at_rate(videos: DataFrame, rate: float) -> DataFrame:
    """Frames nearest to 0, 1/rate, 2/rate ... seconds, half to even; none for a rate of 0 or less."""
    if rate <= 0:
        return every_frame(videos).limit(0)
    steps = F.sequence(F.lit(0), F.ceil(F.col("frame_count") / F.col("fps") * rate).cast("int"))
    rows = videos.filter("frame_count > 0 and fps > 0").withColumn("seconds", F.explode(F.transform(steps, lambda i: i / F.lit(float(rate)))))
    rows = rows.filter(F.col("seconds") < F.col("frame_count") / F.col("fps"))
    return _distinct(rows, F.bround(F.col("seconds") * F.col("fps")).cast("long"))


def at_times(videos: DataFrame, times: DataFrame) -> DataFrame:
    """Frames nearest to times (match_id, seconds) in [0, duration], clamped to the last frame."""
    rows = times.join(videos, "match_id").filter((F.col("seconds") >= 0) & (F.col("seconds") <= F.col("frame_count") / F.col("fps")))
    return _distinct(rows, F.greatest(F.lit(0), F.least(F.bround(F.col("seconds") * F.col("fps")).cast("long"), F.col("frame_count") - 1)))


def listed(videos: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames of a list (match_id, frame_index) that exist, once each, and those that don't."""
    rows = wanted.join(videos, "match_id")
    inside = (F.col("frame_index") >= 0) & (F.col("frame_index") < F.col("frame_count"))
    return rows.filter(inside).select("match_id", "frame_index").distinct(), rows.filter(~inside).select("match_id", "frame_index").distinct()


def resume(frames: DataFrame, frame_index: int | None = None, seconds: float | None = None, fps: float | None = None) -> DataFrame:
    """Frames from a point on; a frame index comes before a time. A point below 0 is an error, and so is, when the
    frames are read, one that a match (frame_count, where frames have it) does not reach."""
    if frame_index is None and seconds is not None:
        frame_index = round(seconds * (fps or 0))
    if frame_index is None:
        return frames
    if frame_index < 0:
        raise ValueError("the resume point is before the first frame")
    rows = frames.filter(F.col("frame_index") >= frame_index)
    if "frame_count" in frames.columns:
        beyond = F.raise_error(F.concat(F.lit("resume point beyond the frames of match "), F.col("match_id").cast("string"))).cast("boolean")
        rows = frames.filter(F.when(F.col("frame_count") <= frame_index, beyond).otherwise(F.col("frame_index") >= frame_index))
    return rows


def effective_fps(stamps: DataFrame, native: float | None = None) -> DataFrame:
    """match_id, fps from the first and last decoded frames (frame_index, timestamp_seconds); the native rate, if given, where they coincide."""
    rows = stamps.groupBy("match_id").agg(F.count("*").alias("n"), (F.max("timestamp_seconds") - F.min("timestamp_seconds")).alias("span"))
    return rows.select("match_id", F.when(F.col("span") > 0, (F.col("n") - 1) / F.col("span")).otherwise(F.lit(native).cast("double")).alias("fps"))


def on_axis(frames: DataFrame, readings: DataFrame) -> DataFrame:
    """A row of readings for each frame (match_id, frame_index); where nothing was read, the fields are null and both confidences 0."""
    rows = frames.select("match_id", "frame_index").join(readings, ["match_id", "frame_index"], "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("ocr_confidence", "parse_confidence")})


def reuse_unchanged(frames: DataFrame, feature: str, tolerance: float = 2.0) -> DataFrame:
    """match_id, frame_index, source_frame: the frame whose reading serves, which is the last one read if the feature is within tolerance of it.

    What was read last depends on what was reused, hence a fold over a match. A null feature is read anew.
    """

    def start():
        read = at = None

        def step(i, x) -> tuple:
            nonlocal read, at
            if read is None or x is None or x != x or abs(x - read) > tolerance:
                read, at = (x if x == x else None), i
            return i, at

        return step

    rows = frames.select("match_id", F.col("frame_index").cast("long").alias("frame_index"), F.col(feature).cast("double").alias("x"))
    return fold_rows(rows, ["match_id"], ["frame_index"], start, "frame_index long, source_frame long")


def _distinct(rows: DataFrame, index: Column) -> DataFrame:
    return rows.withColumn("frame_index", index).filter(F.col("frame_index") < F.col("frame_count")).select("match_id", "frame_index").distinct()
