"""Clip planning: windows around events, snapped to cuts, merged where they meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import concat_line
from .intervals import asof_backward, merge_intervals


def clip_windows(events: DataFrame, durations: DataFrame | None = None, pre: float = 8.0, post: float = 12.0, include_replays: bool = False) -> DataFrame:
    """events with clip_start and clip_end, clamped to the match; replays are left out unless asked for.

    duration_seconds comes from durations by match, or is a column of events.
    """
    if not pre >= 0 or not post >= 0:
        raise ValueError("pre and post are seconds of 0 or more")
    rows = events if durations is None else events.join(durations, "match_id")
    rows = rows if include_replays else rows.filter(~F.coalesce("is_replay", F.lit(False)))
    zero, end = F.lit(0.0), F.col("duration_seconds")
    start = F.greatest(zero, F.least(end, F.col("timestamp_seconds") - pre))
    stop = F.greatest(zero, F.least(end, F.col("timestamp_seconds") + post))
    return rows.withColumns({"clip_start": start, "clip_end": stop}).drop("duration_seconds")


def snap_to_cuts(windows: DataFrame, cuts: DataFrame, most: float) -> DataFrame:
    """windows whose clip_start is the latest cut at most ``most`` seconds before the event, where there is one."""
    cuts = cuts.select("match_id", F.col("timestamp_seconds").alias("cut_seconds"))
    found = asof_backward(windows, cuts, ["match_id"], "timestamp_seconds", "cut_seconds", ["cut_seconds"], most)
    return found.withColumn("clip_start", F.coalesce("cut_seconds", "clip_start"))


def merge_clips(windows: DataFrame, gap: float = 3.0) -> DataFrame:
    """windows with island and merge_reason; gap is in seconds, 0 merges those that touch."""
    if not gap >= 0:
        raise ValueError("gap is 0 or more")
    return merge_intervals(windows.withColumn("input_pos", F.struct("timestamp_seconds", "event_key")), ["match_id"], gap, "clip_start", "clip_end").drop("input_pos")


def clips(merged: DataFrame) -> DataFrame:
    """One row a clip: its id (sorted event keys), start, end, count and flags."""
    return merged.groupBy("match_id", "island").agg(
        F.array_join(F.array_sort(F.collect_list("event_key")), "+").alias("clip_id"),
        F.min("clip_start").alias("start_seconds"),
        F.max("clip_end").alias("end_seconds"),
        F.count("*").alias("n_events"),
        (F.count("*") > 1).alias("merged"),
        F.bool_or(F.coalesce("is_replay", F.lit(False))).alias("is_replay"),
    )


def plan_totals(planned: DataFrame) -> DataFrame:
    """n_clips, total_seconds and mean_seconds of each match."""
    length = F.col("end_seconds") - F.col("start_seconds")
    return planned.groupBy("match_id").agg(F.count("*").alias("n_clips"), F.sum(length).alias("total_seconds"), F.avg(length).alias("mean_seconds"))


def event_ids(planned: DataFrame) -> DataFrame:
    """The distinct event keys of all clips of a match, sorted, as one string."""
    keys = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("clip_id", r"\+")))))
    return planned.groupBy("match_id").agg(F.array_join(keys, ",").alias("event_ids"))


def concat_list(segments: DataFrame) -> DataFrame:
    """match_id and list, the text that names a match's segments (match_id, position, path) in their order, quotes in paths escaped."""
    entry = concat_line(F.col("path"))
    rows = segments.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("position", "path", entry.alias("entry")))).alias("entries"))
    return rows.select("match_id", F.array_join("entries.entry", "\n").alias("list"))
