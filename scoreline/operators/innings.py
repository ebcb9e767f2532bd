"""Innings tracking and reading validation: folds over a match in which a decision depends on earlier decisions.

The kernels work on one match at a time, whose readings its length bounds; matches are spread by Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import fold_rows

# Names of the outcomes.
NOT_A_CANDIDATE = "NOT_A_CANDIDATE"
ACCEPTED = "ACCEPTED"
IMPLAUSIBLE = "REJECTED_IMPLAUSIBLE_RESET"
NO_OVER_BALL = "REJECTED_NO_OVER_BALL_RESET"
NOT_PERSISTENT = "REJECTED_INSUFFICIENT_PERSISTENCE"
TOO_MANY = "REJECTED_MAX_SEGMENTS_REACHED"
# Fixed value: how a decision on a candidate is told.
REASON = "is_decrease={} reset_plausible={} over_ball_reset={} confirmations={}/{}"


@dataclass(frozen=True)
class TrackerConfig:
    # How a new innings is told from a misread score.
    confirmations: int = 2
    low_confidence_factor: float = 2.0
    low_confidence: float = 0.5
    most_reset_runs: int = 20
    most_reset_wickets: int = 2
    most_reset_over: int = 1
    segments: int = 2


class InningsTracker:
    """Feeds on (runs, wickets, over, confidence); says whether a fall of both is the start of a new innings."""

    def __init__(self, config: TrackerConfig = TrackerConfig()) -> None:
        self.config, self.segment, self.confirmed, self.reason = config, 1, 0, None
        self.baseline: tuple[int, int] | None = None

    def state(self) -> tuple:
        """Four plain values that ``resumed`` goes on from."""
        return self.segment, self.confirmed, *(self.baseline or (None, None))

    def resumed(self, state: tuple | None) -> InningsTracker:
        if state is not None:
            self.segment, self.confirmed, *baseline = state
            self.baseline = None if baseline[0] is None else tuple(baseline)
        return self

    def observe(self, runs, wickets, over, confidence=None) -> str:
        """The decision; ``reason`` then tells what it rests on, if the reading was a candidate."""
        c, self.reason = self.config, None
        if runs is None or wickets is None:
            return NOT_A_CANDIDATE
        if self.baseline is None or not (runs < self.baseline[0] and wickets < self.baseline[1]):
            if self.baseline is not None:
                self.confirmed = 0
            self.baseline = (runs, wickets)
            return NOT_A_CANDIDATE
        near_zero, near_start = runs < c.most_reset_runs and wickets <= c.most_reset_wickets, over is not None and over <= c.most_reset_over
        self.confirmed = self.confirmed + 1 if near_zero and near_start else 0
        needed = c.confirmations
        if confidence is not None and confidence < c.low_confidence:
            needed = max(needed, round(needed * c.low_confidence_factor))
        self.reason = REASON.format(True, near_zero, near_zero and near_start, self.confirmed, needed)
        if not near_zero:
            return IMPLAUSIBLE
        if not near_start:
            return NO_OVER_BALL
        if self.confirmed < needed:
            return NOT_PERSISTENT
        if self.segment >= c.segments:
            return TOO_MANY
        self.segment += 1
        self.baseline, self.confirmed = (runs, wickets), 0
        return ACCEPTED


def values(frame: pd.DataFrame, *columns: str) -> list[tuple]:
    """Rows as tuples with None for nulls and plain ints for whole numbers."""
    out = []
    for c in columns:
        column = frame[c]
        whole = not c.endswith(("confidence", "seconds")) and column.dtype.kind in "if"
        out.append([None if pd.isna(x) else int(x) if whole else x for x in column])
    return list(zip(*out, strict=True))


def confidence_of(readings: DataFrame) -> Column:
    return F.coalesce(*(c for c in ("ocr_confidence", "mean_token_confidence", "parse_confidence") if c in readings.columns))


def tag_innings(readings: DataFrame, config: TrackerConfig = TrackerConfig()) -> DataFrame:
    """match_id, reading_id, decision and segment (from 1) of every reading, in order of time.

    A reading's confidence is its ocr_confidence, else the mean of its tokens' (mean_token_confidence, if there is such
    a column), else its parse_confidence.
    """

    return tagged(readings, config).drop("reason")


def tagged(readings: DataFrame, config: TrackerConfig = TrackerConfig()) -> DataFrame:
    """tag_innings with the reason of each decision on a candidate, null for other readings."""

    def start():
        tracker = InningsTracker(config)

        def step(reading_id, _, *values) -> tuple:
            return reading_id, tracker.observe(*values), tracker.segment, tracker.reason

        return step

    rows = readings.select("match_id", "reading_id", "timestamp_seconds", "runs", "wickets", "over_number", confidence_of(readings).alias("confidence"))
    return fold_rows(rows, ["match_id"], ["timestamp_seconds", "reading_id"], start, "reading_id long, decision string, segment int, reason string")


def with_innings(readings: DataFrame, config: TrackerConfig = TrackerConfig()) -> DataFrame:
    """readings with innings, the segment that the tracker finds for them."""
    found = tag_innings(readings, config).select("match_id", "reading_id", F.col("segment").alias("innings"))
    return readings.drop("innings").join(found, ["match_id", "reading_id"])


class ReadingValidator:
    """Checks a reading against the last accepted values; returns None or the reason of its rejection."""

    def __init__(self) -> None:
        self.runs = self.wickets = self.over = self.ball = None
        self.tracker = InningsTracker(TrackerConfig(confirmations=1))

    def state(self) -> tuple:
        return self.runs, self.wickets, self.over, self.ball, *self.tracker.state()

    def resumed(self, state: tuple | None) -> ReadingValidator:
        if state is not None:
            self.runs, self.wickets, self.over, self.ball = state[:4]
            self.tracker.resumed(state[4:])
        return self

    def check(self, runs, wickets, over, ball, batter) -> str | None:
        reason = self._reason(runs, wickets, over, ball, batter)
        if reason is None:
            if runs is not None:
                self.runs = runs
            if wickets is not None:
                self.wickets = wickets
            if runs is not None and wickets is not None:
                self.over, self.ball = (over if over is not None else self.over), (ball if ball is not None else self.ball)
        return reason

    # Names of the reasons, and the order in which they are tried.
    def _reason(self, runs, wickets, over, ball, batter) -> str | None:
        if batter is None and runs is None and wickets is None and over is None and ball is None:
            return "PLAYER_PARSE_FAILED"
        if ball is not None and not 0 <= ball <= 6:
            return "INVALID_BALL_NUMBER"
        if wickets is not None and not 0 <= wickets <= 10:
            return "WICKETS_DECREASED"
        if over is not None and not 0 <= over <= 50:
            return "INVALID_OVER_SEQUENCE"
        lower_runs = runs is not None and self.runs is not None and runs < self.runs
        lower_wickets = wickets is not None and self.wickets is not None and wickets < self.wickets
        same_place = None not in (over, ball, self.over, self.ball) and (over, ball) == (self.over, self.ball)
        if same_place and runs is not None and self.runs is not None and runs != self.runs:
            return "RUNS_DECREASED"
        if lower_runs and lower_wickets:
            return None if self.tracker.observe(runs, wickets, over) == ACCEPTED else "RUNS_DECREASED"
        if lower_runs:
            return "RUNS_DECREASED"
        if lower_wickets:
            return "WICKETS_DECREASED"
        if over is not None and self.over is not None:
            if over < self.over or (over == self.over and ball is not None and self.ball is not None and ball < self.ball):
                return "INVALID_OVER_SEQUENCE"
        self.tracker.observe(runs, wickets, over)
        return None


def validate_readings(readings: DataFrame) -> DataFrame:
    """match_id, reading_id, reason (null if accepted) and parse_confidence (1.0 or 0.0) of every reading."""

    def start():
        validator = ReadingValidator()

        def step(reading_id, _, *values) -> tuple:
            reason = validator.check(*values)
            return reading_id, reason, 0.0 if reason else 1.0

        return step

    rows = readings.select("match_id", "reading_id", "timestamp_seconds", "runs", "wickets", "over_number", "ball_in_over", "batter")
    return fold_rows(rows, ["match_id"], ["timestamp_seconds", "reading_id"], start, "reading_id long, reason string, parse_confidence double")
