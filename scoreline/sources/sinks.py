"""Tables and exports. Tables are Parquet, partitioned by match, and written with Spark's committer: all of a job or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def write_observed(rows: DataFrame, path: str, figures: list[Column], mode: str = "overwrite") -> dict:
    """Write rows, by match, and give figures of all of them (as operators.checks lists them) that the write itself has counted."""
    seen = Observation()
    rows.observe(seen, *figures).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("match_id").parquet(path)
    return seen.get


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("match_id").parquet(path)


def replace_matches(rows: DataFrame, path: str) -> None:
    """Write the matches of rows anew and leave others as they are: the forced second analysis of a match."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("match_id").parquet(path)


def with_event_ids(events: DataFrame, last_ids: DataFrame | None = None) -> DataFrame:
    """Number events of a match in order of time and key, after those it has (match_id, last_id)."""
    order = Window.partitionBy("match_id").orderBy(F.col("timestamp_seconds").asc_nulls_first(), "event_key")
    rows = events.withColumn("event_id", F.row_number().over(order).cast("long"))
    if last_ids is not None:
        rows = rows.join(last_ids, "match_id", "left").withColumn("event_id", F.col("event_id") + F.coalesce("last_id", F.lit(0))).drop("last_id")
    return rows


def set_clip_windows(events: DataFrame, updates: DataFrame) -> DataFrame:
    """events with clip_start and clip_end from updates (match_id, event_id, new_start, new_end) where there is one."""
    rows = events.join(updates, ["match_id", "event_id"], "left")
    return rows.withColumns({"clip_start": F.coalesce("new_start", "clip_start"), "clip_end": F.coalesce("new_end", "clip_end")}).drop("new_start", "new_end")


def export_json(events: DataFrame, readings: DataFrame, path: str) -> None:
    """A line of JSON for each match: match_id, scoreboard_readings, events, both in order of time."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("timestamp_seconds", *(c for c in df.columns if c not in ("match_id", "timestamp_seconds"))))).alias(name))

    listed(readings, "scoreboard_readings").join(listed(events, "events"), "match_id", "full").write.mode("overwrite").json(path)


def export_csv(events: DataFrame, path: str) -> None:
    """Events as CSV with a header; nothing is written for no events."""
    if not events.isEmpty():
        events.write.mode("overwrite").csv(path, header=True)
