"""The folds, one hand-made case after the other."""

import pandas as pd
import pytest

from scoreline.operators.alignment import AnchorWalk
from scoreline.operators.innings import ACCEPTED, IMPLAUSIBLE, NO_OVER_BALL, NOT_A_CANDIDATE, NOT_PERSISTENT, TOO_MANY, InningsTracker, ReadingValidator, TrackerConfig
from scoreline.operators.replay import fallen


def test_tracker_accepts_after_two_confirmations():
    tracker = InningsTracker()
    assert tracker.observe(150, 6, 19) == NOT_A_CANDIDATE
    assert tracker.observe(0, 0, 0) == NOT_PERSISTENT
    assert tracker.observe(1, 0, 0) == ACCEPTED
    assert tracker.segment == 2


def test_tracker_needs_more_where_confidence_is_low():
    tracker = InningsTracker()
    tracker.observe(150, 6, 19)
    assert [tracker.observe(0, 0, 0, 0.3) for _ in range(4)] == [NOT_PERSISTENT] * 3 + [ACCEPTED]


def test_tracker_rejections():
    tracker = InningsTracker(TrackerConfig(confirmations=1))
    tracker.observe(150, 6, 19)
    assert tracker.observe(60, 1, 0) == IMPLAUSIBLE
    assert tracker.observe(5, 0, 7) == NO_OVER_BALL
    assert tracker.observe(5, 0, None) == NO_OVER_BALL
    assert tracker.observe(None, 0, 0) == NOT_A_CANDIDATE
    assert tracker.observe(5, 0, 1) == ACCEPTED
    tracker.observe(90, 4, 10)
    assert tracker.observe(5, 0, 1) == TOO_MANY
    assert tracker.segment == 2


@pytest.mark.parametrize(
    ("rows", "reason"),
    [
        ([(None, None, None, None, None)], "PLAYER_PARSE_FAILED"),
        ([(10, 0, 1, 7, "A")], "INVALID_BALL_NUMBER"),
        ([(10, 11, 1, 1, "A")], "WICKETS_DECREASED"),
        ([(10, 1, 51, 1, "A")], "INVALID_OVER_SEQUENCE"),
        ([(10, 1, 3, 2, "A"), (12, 1, 3, 2, "A")], "RUNS_DECREASED"),
        ([(10, 1, 3, 2, "A"), (9, 1, 3, 3, "A")], "RUNS_DECREASED"),
        ([(10, 1, 3, 2, "A"), (10, 0, 3, 3, "A")], "WICKETS_DECREASED"),
        ([(10, 1, 3, 2, "A"), (10, 1, 2, 3, "A")], "INVALID_OVER_SEQUENCE"),
        ([(10, 1, 3, 2, "A"), (10, 1, 3, 1, "A")], "INVALID_OVER_SEQUENCE"),
        ([(10, 1, 3, 2, "A"), (11, 1, 3, 3, "A")], None),
        ([(150, 5, 19, 5, "A"), (0, 0, 0, 0, "B")], None),
    ],
)
def test_validator(rows, reason):
    validator = ReadingValidator()
    assert [validator.check(*row) for row in rows][-1] == reason


def test_anchor_walk_rejects_a_reading_out_of_order():
    walk = AnchorWalk()
    assert walk.visit(1, 0, [(0, True, 100.0, 10, 0, 0.9)])[:2] == (0, "HIGH")
    rank, tier, *_, rejected, violations, prevented = walk.visit(1, 1, [(0, True, 50.0, 11, 0, 0.9), (1, False, 130.0, 11, 0, 0.4)])
    assert (rank, tier, rejected, violations, prevented) == (1, "MEDIUM", 1, 1, 1)


def test_anchor_walk_suspicious_pace_is_low_and_no_baseline():
    walk = AnchorWalk()
    walk.visit(1, 0, [(0, True, 100.0, 10, 0, 0.9)])
    walk.visit(1, 1, [(0, True, 130.0, 11, 0, 0.9)])
    assert walk.visit(1, 2, [(0, True, 2000.0, 12, 0, 0.9)])[1] == "LOW"
    assert walk.trusted[:2] == (1, 1)


def test_anchor_walk_without_candidates_or_with_bad_ones():
    assert AnchorWalk().visit(1, 0, [])[:2] == (None, "UNRESOLVED")
    assert AnchorWalk().visit(1, 0, [(0, True, 1.0, 0, 0, 0.1)])[:3] == (None, "UNRESOLVED", "INSUFFICIENT")


def test_fallen():
    assert fallen(0.0, 1.0) == 0.0
    assert fallen(4.0, 1.0) == 0.75
    assert fallen(1.0, 4.0) == 0.0
    assert fallen(2.0, -5.0) == 1.0


def test_suppress_close(spark):
    from scoreline.operators.scenes import suppress_close

    cuts = spark.createDataFrame(pd.DataFrame({"match_id": [1] * 5, "frame_index": [0, 3, 4, 7, 9]}))
    assert [r.frame_index for r in suppress_close(cuts).orderBy("frame_index").collect()] == [0, 4, 9]
