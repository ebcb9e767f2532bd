"""The three plans: readings to events, events to clips, events and commentary to a report and repairs.

Everything is keyed by match_id: the windows of smoothing, runs and rules share one exchange on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import alignment, clips, report, rules, smoothing, states
from ..operators.replay import tag_replays


def analyze(readings: DataFrame, replays: DataFrame) -> DataFrame:
    """Events of raw readings, tagged with is_replay; each state is compared with the last accepted one."""
    found = states.state_runs(smoothing.smooth(readings))
    return tag_replays(rules.detect_events(found), replays)


def quick_events(readings: DataFrame, replays: DataFrame) -> DataFrame:
    """The same with neighbouring states compared, by windows alone; it differs where a state is anomalous."""
    found = states.state_runs(smoothing.smooth(readings))
    events = rules.finish_events(rules.with_milestones(rules.pairwise(found).filter("not anomaly")))
    return tag_replays(events, replays)


def with_durations(events: DataFrame, margin: float = 60.0) -> DataFrame:
    """events with duration_seconds, a match's duration where none is known: its last event and a margin."""
    return events.withColumn("duration_seconds", F.max("timestamp_seconds").over(Window.partitionBy("match_id")) + margin)


def generate(events: DataFrame, spans: DataFrame | None = None, pre: float = 8.0, post: float = 12.0, gap: float = 3.0) -> DataFrame:
    """The clip plan of events."""
    return clips.clips(clips.merge_clips(clips.clip_windows(events if spans is not None else with_durations(events), spans, pre, post), gap))


def validate(readings: DataFrame, events: DataFrame, commentary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The aligned commentary, and the accuracy report. A commentary that goes beyond the overs read is an error when either is read."""
    truth = alignment.require_in_range(alignment.ground_truth(commentary), readings)
    both = alignment.reconcile(truth, readings, events)
    return both.filter("side = 'commentary'").drop("side"), report.accuracy(both)
