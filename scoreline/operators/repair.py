"""Repairs with an audit log: events recovered from a commentary, and dismissal details of wickets.

An audit row (match_id, metadata_id, operation) names what was done; what the log already holds is not done again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import dismissal_type, event_key, fielder

RECOVERED_CONFIDENCE = 0.75


def metadata_id() -> Column:
    return F.format_string("%d:%d.%d:%s:%d", "innings", "over_number", "ball_in_over", "event_type", "truth_id")


def recover(aligned: DataFrame, audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events to append for missed ones that have a trusted anchor, and their audit rows."""
    rows = aligned.filter("recovery_eligible").withColumn("metadata_id", metadata_id()).withColumn("operation", F.lit("RECOVERY"))
    rows = rows.join(audit.select("match_id", "metadata_id", "operation"), ["match_id", "metadata_id", "operation"], "left_anti")
    key = event_key(F.col("innings"), F.col("over_number"), F.col("ball_in_over"), F.col("event_type"), F.lit(None).cast("string"))
    events = rows.select(
        "match_id", "innings", F.col("anchor_seconds").alias("timestamp_seconds"), "over_number", "ball_in_over", "event_type", key.alias("event_key"),
        F.lit(RECOVERED_CONFIDENCE).alias("confidence"), F.lit(None).cast("int").alias("importance"), F.lit(False).alias("is_replay"), F.lit("METADATA").alias("source"), "metadata_id",
    )
    return events, rows.select("match_id", "metadata_id", "operation", key.alias("event_key"))


def enrich(aligned: DataFrame, events: DataFrame, audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """events with dismissal_type and fielder of their wickets, and audit rows of those set now.

    A wicket is found by the event it was matched with, or by the audit row of its recovery; only descriptions that tell a kind count.
    """
    rows = aligned.filter("event_type = 'WICKET'").withColumn("metadata_id", metadata_id())
    past = audit.filter("operation = 'RECOVERY'").select("match_id", "metadata_id", F.col("event_key").alias("recovered_key"))
    rows = rows.join(past, ["match_id", "metadata_id"], "left").withColumn("event_key", F.coalesce("event_key", "recovered_key"))
    rows = rows.withColumns({"dismissal_type": dismissal_type(F.col("description")), "fielder": fielder(F.col("description"))})
    rows = rows.filter("event_key is not null and dismissal_type is not null").withColumn("operation", F.lit("ENRICHMENT"))
    rows = rows.join(audit.select("match_id", "metadata_id", "operation"), ["match_id", "metadata_id", "operation"], "left_anti")
    first = F.struct("truth_id")
    set_now = rows.groupBy("match_id", "event_key").agg(F.min_by("dismissal_type", first).alias("new_type"), F.min_by("fielder", first).alias("new_fielder"))
    held = events.withColumns({c: F.lit(None).cast("string") for c in ("dismissal_type", "fielder") if c not in events.columns})
    found = held.join(set_now, ["match_id", "event_key"], "left")
    found = found.withColumns({"dismissal_type": F.coalesce("new_type", "dismissal_type"), "fielder": F.when(F.col("new_type").isNotNull(), F.col("new_fielder")).otherwise(F.col("fielder"))})
    return found.drop("new_type", "new_fielder"), rows.select("match_id", "metadata_id", "operation", "event_key")
