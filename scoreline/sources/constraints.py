"""Constraints of the stored tables, declared once and compiled to one pass over a table.

A constraint is a name and a condition that every row meets (SQL, where null counts as met, as a CHECK has it), a
column that is never null, or columns that no two rows share. Conditions are tested row by row; each set of unique columns takes
one exchange, by a count over those columns, and rows with a null among them do not clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constraints:
    not_null: tuple[str, ...] = ()
    checks: tuple[tuple[str, str], ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()

    def tests(self) -> dict[str, Column]:
        """Name and whether a row breaks it, of all constraints that one row decides."""
        broken = {f"{c} is null": F.col(c).isNull() for c in self.not_null}
        return broken | {name: ~F.coalesce(F.expr(condition), F.lit(True)) for name, condition in self.checks}


def one_of(column: str, *values: str) -> tuple[str, str]:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"{column} is unknown", f"{column} in ({listed})"


def within(column: str, low: float, high: float) -> tuple[str, str]:
    return f"{column} is out of range", f"{column} between {low} and {high}"


def finite(column: str) -> tuple[str, str]:
    return f"{column} is not finite", f"not isnan({column}) and abs({column}) < double('infinity')"


# What the tables of an analysis may hold.
TABLES = {
    "matches": Constraints(("match_id", "source_path", "file_hash"), (one_of("status", "IN_PROGRESS", "COMPLETE", "FAILED"), ("duration is negative", "duration_seconds >= 0")), (("match_id",), ("file_hash",))),
    "readings": Constraints(("match_id", "reading_id", "timestamp_seconds"), (finite("timestamp_seconds"), within("ocr_confidence", 0, 1), within("parse_confidence", 0, 1)), (("match_id", "reading_id"),)),
    "replays": Constraints(("match_id", "start_seconds", "end_seconds"), (finite("start_seconds"), finite("end_seconds"), ("ends before it starts", "start_seconds <= end_seconds"), within("confidence", 0, 1)), ()),
    "events": Constraints(
        ("match_id", "event_key", "timestamp_seconds", "is_replay"),
        (
            one_of("event_type", "FOUR", "SIX", "WICKET", "TEAM_MILESTONE"),
            one_of("source", "OCR", "METADATA"),
            one_of("dismissal_type", "BOWLED", "CAUGHT", "LBW", "RUN_OUT", "STUMPED", "HIT_WICKET"),
            finite("timestamp_seconds"),
            within("confidence", 0, 1),
            ("clip ends before it starts", "clip_start <= clip_end"),
        ),
        (("match_id", "event_id"),),
    ),
    "operations": Constraints(("match_id", "metadata_id"), (one_of("operation", "RECOVERY", "ENRICHMENT"),), (("match_id", "metadata_id", "operation"),)),
    "boundaries": Constraints(("match_id",), (one_of("boundary_type", "ORDINARY_CUT", "REPLAY_TRANSITION"), finite("timestamp_seconds"), within("confidence", 0, 1)), ()),
}


def with_broken(rows: DataFrame, constraints: Constraints) -> DataFrame:
    """rows with ``broken``, the names of the constraints that each breaks. Constraints on columns that rows lack are left out."""
    known = set(rows.columns)
    kept = Constraints(tuple(c for c in constraints.not_null if c in known), tuple(c for c in constraints.checks if _columns_known(rows, c[1])), tuple(u for u in constraints.unique if known.issuperset(u)))
    found = kept.tests()
    counts = {}
    for i, columns in enumerate(kept.unique):
        counts[f"__of{i}"] = F.count("*").over(Window.partitionBy(*columns))
        whole = ~F.coalesce(*(F.when(F.col(c).isNull(), True) for c in columns), F.lit(False))
        found[f"{', '.join(columns)} not unique"] = whole & (F.col(f"__of{i}") > 1)
    names = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in found.items())))
    return rows.withColumns(counts).withColumn("broken", names).drop(*counts) if counts else rows.withColumn("broken", names)


def _columns_known(rows: DataFrame, condition: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        rows.limit(0).filter(condition).schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def violations(rows: DataFrame, constraints: Constraints) -> DataFrame:
    """A row for each constraint that a row breaks: the row's columns, and ``constraint``."""
    return with_broken(rows, constraints).withColumn("constraint", F.explode("broken")).drop("broken")


def required(rows: DataFrame, constraints: Constraints) -> DataFrame:
    """rows, or an error that names what the first bad row breaks, in the pass that reads them."""
    told = F.raise_error(F.concat(F.lit("constraint broken: "), F.array_join("broken", "; "))).cast("boolean")
    return with_broken(rows, constraints).filter(F.when(F.size("broken") > 0, told).otherwise(True)).drop("broken")
