"""Event rules over score states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import anomalous, balls_advanced, event_key, event_of, milestones, single_ball
from .folds import fold_rows
from .innings import ACCEPTED, NOT_A_CANDIDATE, InningsTracker, TrackerConfig

# How important each kind of event is.
IMPORTANCE = {"FOUR": 60, "SIX": 80, "WICKET": 95, "TEAM_MILESTONE": 65}
BEFORE = ("runs", "wickets", "over_number", "ball_in_over", "batter")


def pairwise(states: DataFrame) -> DataFrame:
    """Each state with the one before it in its match and innings: columns prev_*, balls, deltas, anomaly, event_type."""
    order = Window.partitionBy("match_id", "innings").orderBy("state_id")
    rows = states.withColumns({f"prev_{c}": F.lag(c).over(order) for c in (*BEFORE, "start_seconds", "start_confidence", "state_id")}).filter("prev_state_id is not null")
    return judged(rows)


def judged(rows: DataFrame) -> DataFrame:
    """Add balls, runs_delta, wickets_delta, anomaly and event_type to rows with prev_* columns."""
    here, before = (F.col("over_number"), F.col("ball_in_over")), (F.col("prev_over_number"), F.col("prev_ball_in_over"))
    rows = rows.withColumns({"balls": balls_advanced(*here, *before), "runs_delta": F.col("runs") - F.col("prev_runs"), "wickets_delta": F.col("wickets") - F.col("prev_wickets")})
    deltas = F.col("runs_delta"), F.col("wickets_delta")
    return rows.withColumns({"anomaly": anomalous(*deltas, F.col("balls")), "event_type": event_of(*deltas, single_ball(*here, *before))})


def with_milestones(rows: DataFrame, interval: int = 50) -> DataFrame:
    """One row for each event and each milestone of the judged rows; a comparison can give several."""
    reached = F.transform(milestones(F.col("prev_runs"), F.col("runs"), interval), lambda m: F.struct(F.lit("TEAM_MILESTONE").alias("event_type"), m.alias("milestone_value")))
    own = F.when(F.col("event_type").isNotNull(), F.array(F.struct("event_type", F.lit(None).cast("int").alias("milestone_value")))).otherwise(F.array().cast("array<struct<event_type:string,milestone_value:int>>"))
    return rows.withColumn("__e", F.explode(F.concat(own, reached))).drop("event_type").select("*", "__e.*").drop("__e")


def importance(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in IMPORTANCE.items() for x in pair))[kind]


def finish_events(rows: DataFrame) -> DataFrame:
    """Events with key, importance, confidence (the least of the two states' readings' confidences) and dismissed player."""
    return rows.select(
        "match_id", "innings", F.col("start_seconds").alias("timestamp_seconds"), "over_number", "ball_in_over", "event_type", "milestone_value",
        event_key(F.col("innings"), F.col("over_number"), F.col("ball_in_over"), F.col("event_type"), F.col("milestone_value")).alias("event_key"),
        F.when(F.col("event_type") == "WICKET", F.col("prev_batter")).alias("player"), F.lit(None).cast("string").alias("team"),
        F.least("start_confidence", "prev_start_confidence").alias("confidence"), importance(F.col("event_type")).alias("importance"),
    )


def last_accepted(states: DataFrame, track: bool = True) -> DataFrame:
    """The fields of each state, and of the last one that was neither anomalous nor a rejected innings candidate (prev_*), anomaly, decision and segment.

    With track, a tracker that needs one confirmation sees the states that are not anomalous; a state that it
    accepts as a new innings is compared with nothing, and one that it rejects is no baseline. The first state of a
    match has null prev_*.
    """
    config = TrackerConfig(confirmations=1, low_confidence_factor=1.0)
    fields = ["state_id", "runs", "wickets", "over_number", "ball_in_over", "batter", "start_seconds", "start_confidence"]

    def start():
        tracker, base = InningsTracker(config), None

        def step(*row) -> tuple:
            nonlocal base
            *own, confidence = row
            _, runs, wickets, over, ball, *_ = own
            anomaly, decision, compared = False, NOT_A_CANDIDATE, base
            if base is not None:
                balls = (over - base[3]) * 6 + ball - base[4] if over >= base[3] else None
                balls = balls if balls is not None and balls >= 0 else None
                several = balls if balls else 0
                anomaly = wickets - base[2] > (several or 3) or runs - base[1] > 11 * (several or 1)
            if track and not anomaly:
                decision = tracker.observe(runs, wickets, over, confidence)
            if anomaly or decision not in (NOT_A_CANDIDATE, ACCEPTED):
                compared = base if anomaly else None
            else:
                compared, base = (None if decision == ACCEPTED else base), own
            return anomaly, decision, tracker.segment, *own, *(compared or (None,) * len(fields))

        return step

    kinds = ("long", "int", "int", "int", "int", "string", "double", "double")
    schema = ", ".join(["anomaly boolean, decision string, segment int", *(f"{p}{c} {kind}" for p in ("", "prev_") for c, kind in zip(fields, kinds, strict=True))])
    return fold_rows(states.select("match_id", *fields, "mean_confidence"), ["match_id"], ["state_id"], start, schema)


def detect_events(states: DataFrame, interval: int = 50) -> DataFrame:
    """Events of all matches, each state compared with the last accepted one. Anomalous states give none."""
    compared = last_accepted(states).withColumnRenamed("segment", "innings")
    compared = compared.filter(F.col("prev_state_id").isNotNull() & (F.col("decision") == NOT_A_CANDIDATE) & ~F.col("anomaly"))
    rows = judged(compared.drop("anomaly"))
    return finish_events(with_milestones(rows, interval))
