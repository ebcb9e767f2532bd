"""Streaming twins of the timeline's folds. Every stream has event_time, a timestamp that rises with a match's own time.

``state_changes`` takes a match's readings as they come. The others wait for the watermark (see ordered), so that any cut of
the rows into micro-batches, and any restart from the checkpoint, gives the rows of their batch twins:

* ``tag_innings`` and ``validate_readings``: operators.innings; the tracker and the last accepted values are the state.
* ``resolve``: operators.smoothing; the last 2 * window usable readings are the state.
* ``merge_clips``: operators.clips; the open clip is the state, emitted when no later window can reach it.
* ``late_cuts``: operators.scenes; the last LOOK_BACK frames and the cuts with too few later frames are the state.

Late rows, behind the watermark, are dropped by Spark. A match ends, where a fold needs to know, after
``quiet_seconds`` of event time without a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import scenes
from ..operators.innings import InningsTracker, ReadingValidator, TrackerConfig, confidence_of, values
from ..operators.smoothing import CORE, unusable
from .ordered import InOrder, fold

OUT = "match_id long, reading_id long, timestamp_seconds double, over_number int, ball_in_over int, runs int, wickets int"
STATE = "over_number int, ball_in_over int, runs int, wickets int"
#: Frames that a late cut is looked up among, the current one included. Fixed value.
LOOK_BACK = 32
DELAY = "10 minutes"
QUIET = 3600.0


def state_changes(readings: DataFrame) -> DataFrame:
    """A row when a match's core values become others than those of its last complete reading.

    Within a micro-batch, readings are taken in order of time; a match's state is four numbers.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = tuple(state.get) if state.exists else None
        frame = pd.concat(frames).sort_values(["timestamp_seconds", "reading_id"])
        keep = []
        for core in values(frame, *CORE):
            new = None not in core and core != last
            keep.append(new)
            last = core if new else last
        if last is not None:
            state.update(last)
        yield frame.loc[keep, ["match_id", "reading_id", "timestamp_seconds", *CORE]]

    columns = ["match_id", "reading_id", "timestamp_seconds", *CORE]
    return readings.select(*columns).groupBy("match_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


class Tagger(InOrder):
    state = "segment int, confirmed int, runs int, wickets int"

    def take(self, held: tuple | None, row: Row) -> tuple[tuple, list[tuple]]:
        tracker = InningsTracker(self.settings["config"]).resumed(held)
        decision = tracker.observe(row.runs, row.wickets, row.over_number, row.confidence)
        return tracker.state(), [(row.reading_id, decision, tracker.segment)]

    def take_all(self, last: int | None, held: tuple | None, rows: list[Row]) -> tuple[tuple | None, list[tuple]]:
        if not rows:
            return held, []
        tracker = InningsTracker(self.settings["config"]).resumed(held)
        out = [(r.reading_id, tracker.observe(r.runs, r.wickets, r.over_number, r.confidence), tracker.segment) for r in rows]
        return tracker.state(), out


def tag_innings(readings: DataFrame, config: TrackerConfig = TrackerConfig(), delay: str = DELAY) -> DataFrame:
    """match_id, reading_id, decision and segment of every reading, as operators.innings.tag_innings gives them."""
    rows = readings.withColumn("confidence", confidence_of(readings))
    columns = ["reading_id", "timestamp_seconds", "runs", "wickets", "over_number", "confidence"]
    return fold(rows, Tagger, columns, ("timestamp_seconds", "reading_id"), "reading_id long, decision string, segment int", delay, config=config)


class Validator(InOrder):
    state = "runs int, wickets int, over_number int, ball_in_over int, segment int, confirmed int, base_runs int, base_wickets int"

    def take(self, held: tuple | None, row: Row) -> tuple[tuple, list[tuple]]:
        validator = ReadingValidator().resumed(held)
        reason = validator.check(row.runs, row.wickets, row.over_number, row.ball_in_over, row.batter)
        return validator.state(), [(row.reading_id, reason, 0.0 if reason else 1.0)]

    def take_all(self, last: int | None, held: tuple | None, rows: list[Row]) -> tuple[tuple | None, list[tuple]]:
        if not rows:
            return held, []
        validator, out = ReadingValidator().resumed(held), []
        for r in rows:
            reason = validator.check(r.runs, r.wickets, r.over_number, r.ball_in_over, r.batter)
            out.append((r.reading_id, reason, 0.0 if reason else 1.0))
        return validator.state(), out


def validate_readings(readings: DataFrame, delay: str = DELAY) -> DataFrame:
    """match_id, reading_id, reason and parse_confidence of every reading, as operators.innings.validate_readings gives them."""
    columns = ["reading_id", "timestamp_seconds", "runs", "wickets", "over_number", "ball_in_over", "batter"]
    return fold(readings, Validator, columns, ("timestamp_seconds", "reading_id"), "reading_id long, reason string, parse_confidence double", delay)


class Resolver(InOrder):
    """Held: how many readings there were, up to ``window``, and the last 2 * window; said tells those that are settled."""

    state = "n int, near array<struct<reading_id: long, core: struct<over_number: int, ball_in_over: int, runs: int, wickets: int>, said: boolean>>"

    def take(self, held: tuple | None, row: Row) -> tuple[tuple | None, list[tuple]]:
        if row.bad:
            return held, [(row.reading_id, "unusable")]
        window, (n, near) = self.settings["window"], held or (0, [])
        near = [(i, tuple(core), said) for i, core, said in near]
        out = []
        if n < window:
            out.append((row.reading_id, "passed"))
        near.append((row.reading_id, tuple(getattr(row, c) for c in CORE), n < window))
        if len(near) > 2 * window:
            i, core, _ = near[window]
            others = {c for _, c, _ in near[:window] + near[window + 1 :]}
            out.append((i, "outlier" if len(others) == 1 and core not in others else "passed"))
            near[window] = (i, core, True)
            near = near[1:]
        return (min(n + 1, window), near), out

    def due(self, last: int, held: tuple) -> int:
        return last + int(self.settings["quiet_seconds"] * 1e6)

    def finish(self, held: tuple) -> tuple[None, list[tuple]]:
        return None, [(i, "passed") for i, _, said in held[1] if not said]


def resolve(readings: DataFrame, window: int = 2, quiet_seconds: float = QUIET, delay: str = DELAY) -> DataFrame:
    """match_id, reading_id and resolution of every reading, as operators.smoothing.resolve gives them.

    A reading is settled once ``window`` usable ones have followed it, or its match has ended.
    """
    rows = readings.withColumns({"unusable": unusable(), "bad": unusable()})
    columns = ["reading_id", "timestamp_seconds", *CORE, "bad"]
    found = fold(rows, Resolver, columns, ("timestamp_seconds", "reading_id"), "reading_id long, resolution string", delay, ("match_id", "unusable"), window=window, quiet_seconds=quiet_seconds)
    return found.select("match_id", "reading_id", "resolution")


class Merger(InOrder):
    """Held: the next clip's number, and the open clip's start, end, event keys and replay flag, and the event time at which none can join it."""

    state = "island long, first double, frontier double, keys array<string>, is_replay boolean, until long"

    def take(self, held: tuple | None, row: Row) -> tuple[tuple, list[tuple]]:
        island, first, frontier, keys, is_replay, _ = held or (0, None, None, [], False, None)
        out = []
        if keys and row.clip_start - frontier > self.settings["gap"]:
            held, out = self.finish(held)
            island, first, frontier, keys, is_replay, _ = held
        first = row.clip_start if not keys else first
        frontier = row.clip_end if not keys else max(frontier, row.clip_end)
        until = row[-1] + int((frontier + self.settings["gap"] - row.clip_start) * 1e6) + 2
        return (island, first, frontier, [*keys, row.event_key], is_replay or bool(row.is_replay), until), out

    def due(self, last: int, held: tuple) -> int | None:
        return held[5]

    def finish(self, held: tuple) -> tuple[tuple, list[tuple]]:
        island, first, frontier, keys, is_replay, _ = held
        return (island + 1, None, None, [], False, None), [(island, "+".join(sorted(keys)), first, frontier, len(keys), len(keys) > 1, is_replay)]


def merge_clips(windows: DataFrame, gap: float = 3.0, delay: str = DELAY) -> DataFrame:
    """Merged clips, as operators.clips.clips(merge_clips(windows, gap)) gives them; event_time is that of clip_start.

    A clip is emitted once the watermark is beyond its end by more than gap.
    """
    if not gap >= 0:
        raise ValueError("gap is 0 or more")
    columns = ["clip_start", "clip_end", "timestamp_seconds", "event_key", "is_replay"]
    out = "island long, clip_id string, start_seconds double, end_seconds double, n_events long, merged boolean, is_replay boolean"
    return fold(windows, Merger, columns, ("clip_start", "clip_end", "timestamp_seconds", "event_key"), out, delay, gap=float(gap))


class LateCuts(InOrder):
    """Held: the last frames, the cuts that wait for later frames, and the last frame that the latest cut's own evidence covers."""

    state = (
        "recent array<struct<frame_index: long, timestamp_seconds: double, score: double>>, "
        "pending array<struct<frame_index: long, timestamp_seconds: double, score: double, later: array<double>>>, covered long"
    )

    def take(self, held: tuple | None, row: Row) -> tuple[tuple, list[tuple]]:
        reach = self.settings["reach"]
        recent, pending, covered = held or ([], [], None)
        recent = [*map(tuple, recent), (row.frame_index, row.timestamp_seconds, row.score)][-LOOK_BACK:]
        waiting = [(*cut[:3], [*cut[3], row.score]) for cut in pending]
        for at in row.cuts or []:
            if covered is not None and at <= covered:
                continue
            own = next((r for r in recent if r[0] == at), (at, row.timestamp_seconds, row.score))
            waiting.append((*own, [score for i, _, score in recent if at < i <= row.frame_index][:reach]))
            covered = at + reach
        out = [self.classified(cut) for cut in waiting if len(cut[3]) >= reach]
        return (recent, [cut for cut in waiting if len(cut[3]) < reach], covered), out

    def classified(self, cut: tuple) -> tuple:
        at, seconds, score, later = cut
        return (at, seconds, score, *scenes.classify(score, later))

    def due(self, last: int, held: tuple) -> int:
        return last + int(self.settings["quiet_seconds"] * 1e6)

    def finish(self, held: tuple) -> tuple[None, list[tuple]]:
        return None, [self.classified(tuple(cut)) for cut in held[1]]


def late_cuts(frames: DataFrame, reach: int = 3, quiet_seconds: float = QUIET, delay: str = DELAY) -> DataFrame:
    """Cuts of a stream of frames whose ``cuts`` lists the frames that a detector then reports as cuts, itself or earlier ones.

    A cut has the time and score of its own frame, if that is among the last LOOK_BACK, else of the frame that reported it, and
    is classified by the ``reach`` frames after its own, whether they came before the report or after. A cut within
    ``reach`` frames of the one before belongs to that one. The same rows come from scenes.post_cut over the cuts that
    scenes.suppress_close leaves, whatever the delay of the reports below LOOK_BACK.
    """
    columns = ["frame_index", "timestamp_seconds", "score", "cuts"]
    out = "frame_index long, timestamp_seconds double, score double, boundary_type string, confidence double"
    return fold(frames, LateCuts, columns, ("frame_index",), out, delay, reach=reach, quiet_seconds=quiet_seconds)
