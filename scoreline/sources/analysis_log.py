"""The analysis log: an append-only table (match_id, status, at) that tells which matches are analysed.

A match's status is that of its latest row, by ``at`` and, of equal times, the status that comes last in RANK. Nothing is
updated in place, so a lost job leaves at most an IN_PROGRESS row, and the match can be analysed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "match_id long, status string, at double"
RANK = ("FAILED", "IN_PROGRESS", "COMPLETE")


def statuses(log: DataFrame) -> DataFrame:
    """match_id and status of every match in the log; a failed analysis counts as none. Rows with other statuses don't count."""
    rank = F.array_position(F.array(*map(F.lit, RANK)), F.col("status"))
    latest = log.filter(F.col("status").isin(*RANK)).groupBy("match_id").agg(F.max_by("status", F.struct("at", rank)).alias("status"))
    return latest.withColumn("status", F.when(F.col("status") == "FAILED", "NOT_ANALYZED").otherwise(F.col("status")))


def to_analyze(matches: DataFrame, log: DataFrame, force: bool = False) -> DataFrame:
    """The rows of matches whose match is not COMPLETE; all with force, as ``sinks.replace_matches`` then replaces what there is."""
    if force:
        return matches
    return matches.join(statuses(log).filter("status = 'COMPLETE'").select("match_id"), "match_id", "left_anti")


def entries(matches: DataFrame, status: str, at: float) -> DataFrame:
    """Rows to append to the log for each match of matches."""
    if status not in RANK:
        raise ValueError(f"status is one of {', '.join(RANK)}")
    return matches.select("match_id").distinct().select("match_id", F.lit(status).alias("status"), F.lit(float(at)).alias("at"))
