"""Filters of the event query API; every constraint that is None or empty holds for all."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EventFilter:
    player: str | None = None
    team: str | None = None
    event_types: tuple[str, ...] = ()
    least_importance: int | None = None
    first_over: int | None = None
    last_over: int | None = None

    def apply(self, events: DataFrame) -> DataFrame:
        """Rows that meet all constraints, which reach the scan as pushed filters; a null importance meets no minimum."""
        tests = {
            "player": lambda v: F.col("player") == v,
            "team": lambda v: F.col("team") == v,
            "event_types": lambda v: F.col("event_type").isin(*v),
            "least_importance": lambda v: F.col("importance") >= v,
            "first_over": lambda v: F.col("over_number") >= v,
            "last_over": lambda v: F.col("over_number") <= v,
        }
        wanted = [test(v) for name, test in tests.items() if (v := getattr(self, name)) is not None and v != ()]
        return events.filter(reduce(and_, wanted, F.lit(True)))


def in_time_order(events: DataFrame) -> DataFrame:
    return events.orderBy("match_id", F.col("timestamp_seconds").asc_nulls_first(), "event_key")


def complete(rows: DataFrame, core: tuple[str, ...]) -> DataFrame:
    return rows.dropna(subset=list(core))


def without_replays(events: DataFrame, include_replays: bool = False) -> DataFrame:
    return events if include_replays else events.filter(~F.coalesce("is_replay", F.lit(False)))


def find_one(rows: DataFrame, **values) -> DataFrame:
    """At most one row that has these values."""
    return rows.filter(reduce(and_, (F.col(c).eqNullSafe(F.lit(v)) for c, v in values.items()), F.lit(True))).limit(1)


def known(rows: DataFrame, others: DataFrame, keys: list[str], is_known: bool = True) -> DataFrame:
    """The rows whose keys others has, or those whose keys it has not."""
    return rows.join(others.select(*keys), keys, "left_semi" if is_known else "left_anti")


def looked_up(rows: DataFrame, others: DataFrame, keys: list[str], column: str) -> DataFrame:
    """rows with the column of others, the least where several have the keys; null where none has."""
    return rows.join(others.groupBy(*keys).agg(F.min(column).alias(column)), keys, "left")
