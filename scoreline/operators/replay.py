"""Replay intervals: tagging of events, segments between cuts, and scoring of segments by five signals."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from math import sqrt
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import asof_backward

# The weight of each signal, the score where nothing is known, how many live segments make a baseline,
# and the distance of frame features that counts as another camera.
WEIGHTS = {"logo": 0.15, "scoreboard": 0.25, "motion": 0.25, "transition": 0.20, "camera": 0.15}
NEUTRAL = 0.5
WARM = 3
OTHER_CAMERA = 40.0
THRESHOLD = 0.5
LEAST_SECONDS = 3.0


def tag_replays(events: DataFrame, replays: DataFrame) -> DataFrame:
    """events with is_replay: whether the latest interval that starts at or before the event, both ends included, holds it."""
    tagged = asof_backward(events, replays, ["match_id"], "timestamp_seconds", "start_seconds", ["end_seconds"])
    return tagged.withColumn("is_replay", F.coalesce(F.col("timestamp_seconds") <= F.col("end_seconds"), F.lit(False))).drop("end_seconds")


def candidate_segments(boundaries: DataFrame, spans: DataFrame) -> DataFrame:
    """Segments between neighbouring points of {0, the cuts, the match's duration}; empty ones are left out.

    segment_id counts the kept ones of a match from 0; boundary_confidence and boundary_type are those of the cut at the
    start, if any; of several at one time, of the surest.
    """
    cuts = boundaries.groupBy("match_id", F.col("timestamp_seconds").alias("start_seconds")).agg(F.max(F.struct("confidence", "boundary_type")).alias("cut"))
    ends = spans.select("match_id", F.explode(F.array(F.lit(0.0), "duration_seconds")).alias("start_seconds"), F.lit(None).cast("struct<confidence:double,boundary_type:string>").alias("cut"))
    points = cuts.unionByName(ends).groupBy("match_id", "start_seconds").agg(F.max("cut").alias("cut"))
    order = Window.partitionBy("match_id").orderBy("start_seconds")
    rows = points.withColumn("end_seconds", F.lead("start_seconds").over(order)).filter("end_seconds > start_seconds")
    rows = rows.withColumns({"boundary_confidence": F.col("cut.confidence"), "boundary_type": F.col("cut.boundary_type")}).drop("cut")
    return rows.withColumn("segment_id", F.row_number().over(order) - 1)


def frames_to_segments(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """frames with segment_id of the half-open segment [start, end) that holds them; null outside."""
    found = asof_backward(frames, segments, ["match_id"], "timestamp_seconds", "start_seconds", ["segment_id", "end_seconds"])
    return found.withColumn("segment_id", F.when(F.col("timestamp_seconds") < F.col("end_seconds"), F.col("segment_id"))).drop("end_seconds")


def segment_evidence(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """segments with n_frames and the means of their frames' logo, scoreboard, motion, intensity and contrast; null without frames.

    Segments after the last one that holds a frame were never looked at and are left out. Frames are added in order of
    time, so that a mean, and a score at the threshold, does not follow from how the rows were dealt.
    """
    inside = frames_to_segments(frames, segments).filter("segment_id is not null")
    shown = F.array_sort(F.collect_list(F.struct("timestamp_seconds", *MEASURES)))
    means = inside.groupBy("match_id", "segment_id").agg(shown.alias("__shown")).select("match_id", "segment_id", F.size("__shown").cast("long").alias("n_frames"), *(_mean(c) for c in MEASURES))
    rows = segments.join(means, ["match_id", "segment_id"], "left").withColumn("n_frames", F.coalesce("n_frames", F.lit(0)))
    last = F.max(F.when(F.col("n_frames") > 0, F.col("segment_id"))).over(Window.partitionBy("match_id"))
    return rows.withColumn("__last", F.coalesce(last, F.lit(0))).filter("segment_id <= __last").drop("__last")


def _mean(c: str) -> Column:
    known = F.filter(F.transform("__shown", lambda x: x[c].cast("double")), lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, v: s + v), F.size(known).cast("double")).alias(c)


MEASURES = ("logo", "scoreboard", "motion", "intensity", "contrast")
EVIDENCE = "match_id long, segment_id int, start_seconds double, end_seconds double, logo_score double, scoreboard_score double, motion_score double, transition_score double, camera_score double, score double, is_replay boolean"


def fallen(base: float, x: float) -> float:
    """How far x fell below the baseline, as a share of it, 0 to 1; 0 for a baseline of 0 or less."""
    return 0.0 if base <= 0 else min(1.0, max(0.0, (base - x) / base))


def added(values: Iterable[float]) -> float:
    """The sum, one value after another as SQL adds; sum() carries what rounding loses along, and a score at the threshold may then be another."""
    return reduce(add, values, 0.0)


def score_segments(segments: DataFrame, threshold: float = THRESHOLD, least_seconds: float = LEAST_SECONDS, warm: int = WARM) -> DataFrame:
    """The five signals, score, is_replay and replay_id (from 0 in order of time, null if it is none) of each segment.

    The logo signal is the mean match of its template, the transition signal the confidence of a REPLAY_TRANSITION at
    the start. The others compare with the mean of the segments found live so far, and are NEUTRAL until there are
    ``warm`` of them or where the segment has no frames: how far scoreboard and motion fell, and how far intensity and
    contrast are from the baseline's. A segment below the threshold is live and, if it has frames, feeds the baseline; the
    others are replays if long enough. What feeds the baseline depends on the score before it, hence a fold.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("segment_id")
        sums, n, out = dict.fromkeys(MEASURES[1:], 0.0), 0, []
        for row in frame.to_dict("records"):
            has = row["n_frames"] > 0
            signals = {"logo": row["logo"] if has else 0.0, **dict.fromkeys(("scoreboard", "motion"), NEUTRAL)}
            signals |= {"transition": row["boundary_confidence"] if row["boundary_type"] == "REPLAY_TRANSITION" else 0.0, "camera": NEUTRAL}
            if has and n >= warm:
                signals |= {k: fallen(sums[k] / n, row[k]) for k in ("scoreboard", "motion")}
                far = sqrt(sum((row[k] - sums[k] / n) ** 2 for k in ("intensity", "contrast")))
                signals["camera"] = min(1.0, far / OTHER_CAMERA)
            total = min(1.0, max(0.0, added(WEIGHTS[k] * v for k, v in signals.items())))
            live = total < threshold
            if live and has:
                n += 1
                for k in sums:
                    sums[k] += row[k]
            span = row["start_seconds"], row["end_seconds"]
            out.append((row["match_id"], row["segment_id"], *span, *signals.values(), total, not live and span[1] - span[0] >= least_seconds))
        return pd.DataFrame(out, columns=[c.split()[0] for c in EVIDENCE.split(", ")])

    found = segments.groupBy("match_id").applyInPandas(fold, EVIDENCE)
    order = Window.partitionBy("match_id", "is_replay").orderBy("start_seconds", "end_seconds")
    return found.withColumn("replay_id", F.when(F.col("is_replay"), F.row_number().over(order) - 1))


def outcomes(scored: DataFrame) -> DataFrame:
    """Per match: segments taken as replays and not, mean and largest score of those taken, their longest and their total length.

    Scores and lengths are added in order of the segments, so that sums do not follow from how the rows were dealt.
    """
    taken = F.array_sort(F.collect_list(F.when(F.col("is_replay"), F.struct("segment_id", "score", (F.col("end_seconds") - F.col("start_seconds")).alias("length")))))
    rows = scored.groupBy("match_id").agg(F.count_if("is_replay").alias("n_accepted"), F.count_if(~F.col("is_replay")).alias("n_rejected"), taken.alias("__taken"))
    of = {c: F.col(f"__taken.{c}") for c in ("score", "length")}
    sums = {c: F.aggregate(values, F.lit(0.0), lambda s, v: s + v) for c, values in of.items()}
    return rows.select(
        "match_id", "n_accepted", "n_rejected", F.try_divide(sums["score"], F.size("__taken").cast("double")).alias("mean_score"), F.array_max(of["score"]).alias("max_score"),
        F.array_max(of["length"]).alias("longest_seconds"), sums["length"].alias("total_seconds"),
    )
