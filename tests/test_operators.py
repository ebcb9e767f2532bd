"""Windows, joins and functions on hand-made rows."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreline.functions import scalar
from scoreline.operators import alignment, checks, clips, filters, innings, intervals, repair, replay, report, smoothing, states, strategy, tokens
from scoreline.sources import analysis_log, commentary, constraints, files, frames, sinks

READING = "match_id long, innings int, timestamp_seconds double, reading_id long, over_number int, ball_in_over int, runs int, wickets int, batter string, ocr_confidence double, parse_confidence double"


def readings(spark, runs, confidence=None):
    confidence = confidence or [1.0] * len(runs)
    return spark.createDataFrame([(1, 1, float(i), i, 0, 0, r, 0, "A", c, 1.0) for i, (r, c) in enumerate(zip(runs, confidence, strict=True))], READING)


def in_order(df, column):
    return [r[column] for r in df.orderBy("reading_id").collect()]


def test_outlier_and_hold_forward(spark):
    df = smoothing.resolve(readings(spark, [5, 5, 900, 5, 5, None, 6, 6]))
    assert in_order(df, "resolution") == ["passed", "passed", "outlier", "passed", "passed", "passed", "passed", "passed"]
    assert in_order(smoothing.hold_forward(df), "runs") == [5, 5, 5, 5, 5, None, 6, 6]


def test_outlier_near_the_edge_and_real_changes_stay(spark):
    assert set(in_order(smoothing.resolve(readings(spark, [5, 900, 5, 5, 5])), "resolution")) == {"passed"}
    assert set(in_order(smoothing.resolve(readings(spark, [5, 5, 9, 9, 9, 9])), "resolution")) == {"passed"}


def test_leading_gap_is_null_and_partial_rows_do_not_seed(spark):
    df = smoothing.resolve(readings(spark, [7, None, 8, 8], [0.0, 1.0, 0.0, 1.0]))
    assert in_order(smoothing.hold_forward(df), "runs") == [None, None, None, 8]


def test_runs_of_states(spark):
    df = smoothing.hold_forward(smoothing.resolve(readings(spark, [5, 5, None, 5, 6, 5])))
    found = states.state_runs(df).orderBy("state_id").collect()
    assert [(r.runs, r.n_samples) for r in found] == [(5, 3), (6, 1), (5, 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], READING)
    assert states.state_runs(smoothing.smooth(none), none).count() == 0


def test_merge_labels(spark):
    rows = [(1, 0.0, 10.0, 0), (1, 5.0, 12.0, 1), (1, 11.5, 30.0, 2), (1, 33.0, 40.0, 3), (1, 50.0, 60.0, 4), (1, 60.0, 61.0, 5)]
    df = spark.createDataFrame(rows, "match_id long, start_seconds double, end_seconds double, input_pos int")
    found = intervals.merge_intervals(df, ["match_id"], 3.0).orderBy("input_pos").collect()
    assert [(r.island, r.merge_reason) for r in found] == [(0, None), (0, "OVERLAP"), (0, "GAP_THRESHOLD"), (0, "CHAIN_MERGE"), (1, None), (1, "OVERLAP")]


def test_asof_is_inclusive_and_has_a_tolerance(spark):
    left = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 9.0), (2, 1.0)], "match_id long, t double")
    right = spark.createDataFrame([(1, 2.0, "a"), (1, 3.0, "b")], "match_id long, s double, v string")
    found = intervals.asof_backward(left, right, ["match_id"], "t", "s", ["v"], tolerance=6.0)
    assert {(r.match_id, r.t): r.v for r in found.collect()} == {(1, 1.0): None, (1, 2.0): "a", (1, 9.0): "b", (2, 1.0): None}


def test_clip_windows_are_clamped(spark):
    events = spark.createDataFrame([(1, 2.0, "a", False), (1, 99.0, "b", False), (1, 50.0, "c", True), (1, 500.0, "d", False)], "match_id long, timestamp_seconds double, event_key string, is_replay boolean")
    spans = spark.createDataFrame([(1, 100.0)], "match_id long, duration_seconds double")
    found = {r.event_key: (r.clip_start, r.clip_end) for r in clips.clip_windows(events, spans).collect()}
    assert found == {"a": (0.0, 14.0), "b": (91.0, 100.0), "d": (100.0, 100.0)}


@pytest.mark.parametrize("bad", [{"pre": -1.0}, {"post": float("nan")}])
def test_clip_windows_refuse_bad_seconds(spark, bad):
    with pytest.raises(ValueError):
        clips.clip_windows(spark.range(1), spark.range(1), **bad)


def test_scalars(spark):
    df = spark.createDataFrame([("19.5", "OUT c Lee b Rao", "30000/1001"), ("0.1", "ABOUT a SIX", "25/0")], "ball string, text string, rate string")
    found = df.select(scalar.over_of(F.col("ball")), scalar.ball_of(F.col("ball")), scalar.classify_delivery(F.col("text")), scalar.dismissal_type(F.col("text")), scalar.fielder(F.col("text")), F.round(scalar.frame_rate(F.col("rate")), 3)).collect()
    assert [tuple(r) for r in found] == [(19, 5, "WICKET", "CAUGHT", "Lee", 29.97), (0, 1, "SIX", None, None, None)]


def test_malformed_ball_is_an_error(spark):
    df = spark.createDataFrame([("19",)], "ball string")
    with pytest.raises(Exception, match="over.ball"):
        df.select(scalar.over_of(F.col("ball"))).collect()


def test_milestones(spark):
    df = spark.createDataFrame([(40, 160), (50, 50), (49, 50), (60, 20)], "a int, b int")
    assert [r[0] for r in df.select(scalar.milestones(F.col("a"), F.col("b"))).collect()] == [[50, 100, 150], [], [50], []]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (["88/2", "9.4", "Okoro*", "Lund", "B:", "Petit"], ("generic", 88, 2, 9, 4, "Okoro", "Lund", "Petit", None)),
        (["OKORO", "7(5)", "ANN", "LUND", "2", "(3)", "_9-1/1.2(20)", "PETIT", "0-4(1)"], ("club", 9, 1, 1, 2, "OKORO", "ANN LUND", "PETIT", None)),
        (["Www", "12-0", "1.0,", "(20)]", "Mo", "Ali", "x", "0-12", "(1)", "CRR:", "12.00"], ("separate", 12, 0, 1, 0, None, None, "Mo Ali", 12.0)),
        (["Www", "(90-5", "13.3", "20)"], ("separate", 90, 5, 13, 3, None, None, None, None)),
        ([], ("generic", None, None, None, None, None, None, None, None)),
    ],
)
def test_tokens(spark, text, want):
    df = spark.createDataFrame([([(t, 90.0) for t in text],)], "tokens array<struct<text:string,conf:double>>")
    r = tokens.parse(df).first()
    assert (r.layout, r.runs, r.wickets, r.over_number, r.ball_in_over, r.batter, r.non_striker, r.bowler, r.run_rate) == want


def test_filters(spark):
    df = spark.createDataFrame([("A", "SIX", 80, 3), ("B", "FOUR", None, 3), ("A", "FOUR", 60, 9)], "player string, event_type string, importance int, over_number int")
    assert filters.EventFilter().apply(df).count() == 3
    assert filters.EventFilter(player="A", last_over=5).apply(df).count() == 1
    assert filters.EventFilter(least_importance=0).apply(df).count() == 2


def test_frames(spark):
    videos = spark.createDataFrame([(1, 10, 2.0)], "match_id long, frame_count int, fps double")
    assert sorted(r.frame_index for r in frames.at_rate(videos, 1.0).collect()) == [0, 2, 4, 6, 8]
    assert frames.at_rate(videos, 0.0).count() == 0
    times = spark.createDataFrame([(1, 0.25), (1, 5.0), (1, 9.0), (1, -1.0)], "match_id long, seconds double")
    assert sorted(r.frame_index for r in frames.at_times(videos, times).collect()) == [0, 9]
    kept, dropped = frames.listed(videos, spark.createDataFrame([(1, 3), (1, 3), (1, 12)], "match_id long, frame_index int"))
    assert (kept.count(), dropped.count()) == (1, 1)


def test_files(spark, tmp_path):
    content = bytes(range(256)) * 10
    (tmp_path / "a.MP4").write_bytes(content)
    (tmp_path / "b.avi").write_bytes(b"x")
    found = {r.path[-5:]: r for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert found["a.MP4"].file_hash == hashlib.sha256(content + str(len(content)).encode()).hexdigest()
    assert found["a.MP4"].match_id == found["a.MP4"].file_hash[:12]
    assert {k: r.status for k, r in found.items()} == {"a.MP4": "OK", "b.avi": "UNSUPPORTED_FORMAT"}
    df = spark.createDataFrame([(bytearray(content),)], "c binary")
    for edge in (100, 2000):
        tail = content[max(edge, len(content) - edge) :]
        assert df.select(files.sampled_hash(F.col("c"), F.length("c"), edge)).first()[0] == hashlib.sha256(content[:edge] + tail + str(len(content)).encode()).hexdigest()


def test_commentary(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"innings": [{"innings": 1, "commentary": [{"ball": "0.1", "description": "FOUR"}, {"ball": "0.2", "description": "dot"}]}]}))
    assert [(r.ball, r.description) for r in commentary.read_commentary(spark, str(path), 7).orderBy("delivery_id").collect()] == [("0.1", "FOUR"), ("0.2", "dot")]
    path.write_text('{"innings": [')
    with pytest.raises(Exception):
        commentary.read_commentary(spark, str(path)).collect()


EVENT = "match_id long, innings int, timestamp_seconds double, event_type string, event_key string, confidence double"


def test_sinks(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, 2.0, "SIX", "b", 0.5), (1, 1, 1.0, "FOUR", "a", 0.5), (2, 1, 1.0, "GOAL", "c", 2.0)], EVENT)
    assert {(r.match_id, r.event_key): r.event_id for r in sinks.with_event_ids(events, spark.createDataFrame([(1, 10)], "match_id long, last_id long")).collect()} == {(1, "a"): 11, (1, "b"): 12, (2, "c"): 1}
    assert [sorted(r.broken) for r in constraints.with_broken(events, constraints.TABLES["events"]).filter("size(broken) > 0").collect()] == [["confidence is out of range", "event_type is unknown"]]
    sinks.append(events, f"{tmp_path}/t")
    sinks.replace_matches(events.filter("event_key = 'a'"), f"{tmp_path}/t")
    assert {r.event_key for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {"a", "c"}
    sinks.export_csv(events.limit(0), f"{tmp_path}/none")
    assert not (tmp_path / "none").exists()
    sinks.export_json(events, events.drop("event_type"), f"{tmp_path}/json")
    first = spark.read.json(f"{tmp_path}/json").filter("match_id = 1").first()
    assert [e.event_key for e in first.events] == ["a", "b"]


def test_repair_is_idempotent(spark):
    columns = "match_id long, truth_id long, innings int, over_number int, ball_in_over int, event_type string, description string, anchor_seconds double, event_key string, recovery_eligible boolean"
    aligned = spark.createDataFrame([(1, 1, 1, 2, 3, "WICKET", "OUT c Lee b Rao", 9.0, None, True), (1, 2, 1, 2, 4, "FOUR", "FOUR", 10.0, None, False)], columns)
    audit = spark.createDataFrame([], "match_id long, metadata_id string, operation string, event_key string")
    events, log = repair.recover(aligned, audit)
    assert [(r.event_key, r.importance, r.source) for r in events.collect()] == [("1:2.3:WICKET", None, "METADATA")]
    assert repair.recover(aligned, log)[0].count() == 0
    found, more = repair.enrich(aligned, events, log)
    assert [(r.dismissal_type, r.fielder) for r in found.collect()] == [("CAUGHT", "Lee")]
    assert repair.enrich(aligned, found, log.unionByName(more))[1].count() == 0


def test_stream_gives_the_batch_changes(spark, tmp_path):
    from scoreline.streaming.timeline import state_changes

    df = readings(spark, [5, 5, None, 6, 6, 5])
    for i in range(2):
        df.filter(f"reading_id div 3 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    running = state_changes(stream).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    running.processAllAvailable()
    running.stop()
    assert [r.runs for r in spark.sql("select runs from changes order by reading_id").collect()] == [5, 6, 5]


def test_analysis_log(spark):
    log = spark.createDataFrame([(1, "IN_PROGRESS", 0.0), (1, "COMPLETE", 1.0), (2, "COMPLETE", 0.0), (2, "FAILED", 5.0), (3, "IN_PROGRESS", 2.0), (4, "unknown", 9.0), (5, "COMPLETE", 3.0), (5, "IN_PROGRESS", 3.0), (6, None, None)], analysis_log.SCHEMA)
    assert {r.match_id: r.status for r in analysis_log.statuses(log).collect()} == {1: "COMPLETE", 2: "NOT_ANALYZED", 3: "IN_PROGRESS", 5: "COMPLETE"}
    matches = spark.range(1, 8).withColumnRenamed("id", "match_id")
    assert sorted(r.match_id for r in analysis_log.to_analyze(matches, log).collect()) == [2, 3, 4, 6, 7]
    assert analysis_log.to_analyze(matches, log, force=True).count() == 7
    assert analysis_log.statuses(log.unionByName(analysis_log.entries(matches, "COMPLETE", 10.0))).filter("status = 'COMPLETE'").count() == 7
    with pytest.raises(ValueError):
        analysis_log.entries(matches, "DONE", 1.0)


def test_unchanged_frames_reuse_the_last_one_read(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.0, 1.5, 3.0, 4.5, None, 4.5, 4.0])], "match_id long, frame_index long, x double")
    assert [r.source_frame for r in frames.reuse_unchanged(df, "x", 2.0).orderBy("frame_index").collect()] == [0, 0, 2, 2, 4, 5, 5]


def test_bad_boundaries(spark):
    rows = [(1.0, "ORDINARY_CUT", 0.5), (None, "ORDINARY_CUT", 0.5), (float("nan"), "ORDINARY_CUT", 0.5), (1.0, "FADE", 0.5), (1.0, "ORDINARY_CUT", 1.5), (1.0, None, None)]
    assert checks.bad_boundaries(spark.createDataFrame(rows, "timestamp_seconds double, boundary_type string, confidence double")).count() == 5


def test_reading_checks(spark):
    rows = [(1, 1, 0.0, 1, 1, 5, 0, 0.5, 1.0), (1, 2, 0.0, 1, 1, None, 0, 1.5, 1.0), (1, 3, None, None, None, None, None, None, 0.0)]
    df = spark.createDataFrame(rows, "match_id long, reading_id long, timestamp_seconds double, over_number int, ball_in_over int, runs int, wickets int, ocr_confidence double, parse_confidence double")
    assert {r.metric: r.value for r in checks.reading_checks(df).collect()} == {"readings": 3, "without_time": 1, "out_of_order": 1, "incomplete": 2, "bad_confidence": 2}
    stats = checks.reading_stats(df).first()
    assert (stats.n_readings, stats.undetectable, stats.low_confidence, stats.rejected) == (3, 1, 0, 0)


def test_misses_without_a_signal_come_first(spark):
    rows = [(1, 1, 0, 1, 10, "FOUR", "RECOVERABLE_MISS"), (1, 1, 0, 2, 11, "SIX", "TRUE_POSITIVE"), (1, 1, 3, 1, 12, "SIX", "UNRECOVERABLE_MISS")]
    df = spark.createDataFrame(rows, "match_id long, innings int, over_number int, ball_in_over int, truth_id long, event_type string, outcome string")
    assert [(r.truth_id, r.place) for r in report.misses(df).orderBy("place").collect()] == [(12, 1), (10, 2)]


def test_ocr_quality(spark):
    df = spark.createDataFrame([(0.6,), (0.59,), (0.35,), (0.15,), (0.0,), (None,)], "c double")
    assert [r[0] for r in df.select(scalar.ocr_quality(F.col("c"))).collect()] == ["HIGH", "MEDIUM", "MEDIUM", "LOW", "INSUFFICIENT", "UNKNOWN"]


def test_commentary_beyond_the_overs_read_is_an_error(spark):
    rows = readings(spark, [5, 5, 6])
    truth = spark.createDataFrame([(1, 1, 0, 2, "FOUR", "FOUR", 7), (1, 1, 3, 0, "SIX", "SIX", 8)], "match_id long, innings int, over_number int, ball_in_over int, event_type string, description string, truth_id long")
    assert alignment.require_in_range(truth.filter("over_number = 0"), rows).count() == 1
    with pytest.raises(Exception, match=r"match 1 innings 1 over 3 \(read up to 0\)"):
        alignment.require_in_range(truth, rows).collect()


def test_resume_points(spark):
    df = spark.createDataFrame([(1, i, 5) for i in range(5)], "match_id long, frame_index long, frame_count long")
    assert sorted(r.frame_index for r in frames.resume(df, 3, seconds=0.0, fps=25.0).collect()) == [3, 4]
    assert sorted(r.frame_index for r in frames.resume(df, seconds=0.08, fps=25.0).collect()) == [2, 3, 4]
    with pytest.raises(ValueError, match="before the first"):
        frames.resume(df, -1)
    with pytest.raises(Exception, match="beyond the frames of match 1"):
        frames.resume(df, 5).collect()


def test_frame_rate_falls_back_to_the_native_one(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (2, 0, 0.0), (2, 1, 0.5)], "match_id long, frame_index long, timestamp_seconds double")
    assert {r.match_id: r.fps for r in frames.effective_fps(df, 30.0).collect()} == {1: 30.0, 2: 2.0}
    assert {r.match_id: r.fps for r in frames.effective_fps(df).collect()} == {1: None, 2: 2.0}


def test_innings_confidence_falls_back(spark):
    """A low confidence asks for more confirmations, wherever it comes from."""
    rows = [(1, float(i), i, r, w, 0, None, t, p) for i, (r, w, t, p) in enumerate([(90, 5, 0.9, 1.0), (3, 0, 0.9, 0.0), (4, 0, 0.9, 0.0), (80, 4, 0.9, 1.0)])]
    schema = "match_id long, timestamp_seconds double, reading_id long, runs int, wickets int, over_number int, ocr_confidence double, mean_token_confidence double, parse_confidence double"
    df = spark.createDataFrame(rows, schema)
    assert in_order(innings.tag_innings(df), "decision")[1:3] == ["REJECTED_INSUFFICIENT_PERSISTENCE", "ACCEPTED"]
    assert in_order(innings.tag_innings(df.drop("mean_token_confidence")), "decision")[1:3] == ["REJECTED_INSUFFICIENT_PERSISTENCE"] * 2
    assert in_order(innings.with_innings(df), "innings") == [1, 1, 2, 2]


def segments(spark, rows):
    return spark.createDataFrame([(1, i, float(10 * i), float(10 * i + seconds), *more) for i, (seconds, *more) in enumerate(rows)], "match_id long, segment_id int, start_seconds double, end_seconds double, boundary_confidence double, boundary_type string, n_frames int, logo double, scoreboard double, motion double, intensity double, contrast double")


def test_segment_signals(spark):
    live = (10, None, None, 4, 0.0, 8.0, 20.0, 100.0, 30.0)
    replay_cut = (10, 0.8, "REPLAY_TRANSITION", 4, 1.0, 2.0, 5.0, 130.0, 70.0)
    plain_cut = (10, 0.8, "ORDINARY_CUT", 4, 1.0, 8.0, 20.0, 100.0, 30.0)
    nothing_seen = (10, 0.9, "REPLAY_TRANSITION", 0, None, None, None, None, None)
    short = (2, *replay_cut[1:])
    got = replay.score_segments(segments(spark, [live, live, live, replay_cut, plain_cut, nothing_seen, short])).orderBy("segment_id").collect()
    cold = 0.25 * 0.5 + 0.25 * 0.5 + 0.15 * 0.5
    assert [r.score for r in got[:3]] == pytest.approx([cold] * 3)
    # A strong logo raises the score, the boundary counts by its type, and far features are another camera.
    assert (got[3].logo_score, got[3].scoreboard_score, got[3].motion_score, got[3].transition_score, got[3].camera_score) == pytest.approx((1.0, 0.75, 0.75, 0.8, 1.0))
    assert got[3].score == pytest.approx(0.15 + 0.25 * 0.75 * 2 + 0.2 * 0.8 + 0.15)
    assert (got[4].logo_score, got[4].transition_score, got[4].score) == pytest.approx((1.0, 0.0, 0.15))
    assert (got[5].logo_score, got[5].scoreboard_score, got[5].camera_score, got[5].score) == pytest.approx((0.0, 0.5, 0.5, cold + 0.2 * 0.9))
    assert [r.is_replay for r in got] == [False, False, False, True, False, True, False]  # the last is too short
    assert [r.replay_id for r in got] == [None, None, None, 0, None, 1, None]
    totals = replay.outcomes(replay.score_segments(segments(spark, [live, live, live, replay_cut]))).first()
    assert (totals.n_accepted, totals.n_rejected, totals.longest_seconds) == (1, 3, 10.0)


def test_segments_after_the_last_frame_are_left_out(spark):
    cuts = spark.createDataFrame([(1, 10.0, "REPLAY_TRANSITION", 0.7), (1, 10.0, "ORDINARY_CUT", 0.9), (1, 20.0, "ORDINARY_CUT", 0.5)], "match_id long, timestamp_seconds double, boundary_type string, confidence double")
    found = replay.candidate_segments(cuts, spark.createDataFrame([(1, 30.0)], "match_id long, duration_seconds double"))
    assert [(r.start_seconds, r.boundary_type) for r in found.orderBy("segment_id").collect()] == [(0.0, None), (10.0, "ORDINARY_CUT"), (20.0, "ORDINARY_CUT")]
    seen = spark.createDataFrame([(1, 12.0, 0.1, 1.0, 2.0, 3.0, 4.0), (1, 14.0, 0.3, 1.0, 2.0, 3.0, 4.0)], "match_id long, timestamp_seconds double, logo double, scoreboard double, motion double, intensity double, contrast double")
    rows = replay.segment_evidence(seen, found).orderBy("segment_id").collect()
    assert [(r.segment_id, r.n_frames, r.logo) for r in rows] == [(0, 0, None), (1, 2, pytest.approx(0.2))]


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 4), (2, "b", 6)], "match_id long, name string, x int")
    asked = spark.createDataFrame([(1, "a"), (3, "c")], "match_id long, name string")
    assert filters.find_one(df, match_id=1, name="a").count() == 1 and filters.find_one(df, match_id=9).count() == 0
    assert [r.match_id for r in filters.known(asked, df, ["match_id", "name"]).collect()] == [1]
    assert [r.match_id for r in filters.known(asked, df, ["match_id", "name"], is_known=False).collect()] == [3]
    assert {r.match_id: r.x for r in filters.looked_up(asked, df, ["match_id", "name"], "x").collect()} == {1: 4, 3: None}


def test_accuracy_and_document_of_both_sides(spark):
    rows = [
        (1, "commentary", 1, 0, 2, 7, "SIX", "UNRECOVERABLE_MISS", None), (1, "commentary", 1, 0, 1, 8, "SIX", "RECOVERABLE_MISS", None), (1, "commentary", 1, 0, 3, 9, "FOUR", "TRUE_POSITIVE", "a"),
        (1, "detected", 1, None, None, None, "FOUR", "TRUE_POSITIVE", "a"), (1, "detected", 1, None, None, None, "SIX", "FALSE_POSITIVE", "b"), (2, "detected", 1, None, None, None, "SIX", "FALSE_POSITIVE", "c"),
        (3, "commentary", 1, 0, 1, 1, "FOUR", "TRUE_POSITIVE", "d"),
    ]
    both = spark.createDataFrame(rows, "match_id long, side string, innings int, over_number int, ball_in_over int, truth_id long, event_type string, outcome string, event_key string")
    found = {(r.match_id, r.metric): r.value for r in report.accuracy(both).collect()}
    assert {m: v for (i, m), v in found.items() if i == 1} == {
        "total": 3, "true_positives": 1, "missed_no_signal": 1, "missed_with_signal": 1, "recall_four": 1.0, "recall_six": 0.0, "n_detected": 2, "false_positives": 1, "precision": 0.5, "success_rate": 2 / 3,
    }
    assert {i for i, _ in found} == {1, 3} and found[3, "precision"] == 0.0
    got = {r.match_id: json.loads(r.report) for r in report.as_document(both).collect()}
    assert got[1]["missed_events"] == [{"place": 1, "truth_id": 7, "event_type": "SIX", "has_signal": False}, {"place": 2, "truth_id": 8, "event_type": "SIX", "has_signal": True}]
    assert got[1]["figures"]["success_rate"] == 0.666667 and "recall_wicket" not in got[1]["figures"] and got[3]["missed_events"] == []
    assert sorted((r.match_id, r.event_key) for r in report.false_positives(both).collect()) == [(1, "b"), (2, "c")]


@pytest.mark.parametrize("seed", range(20))
def test_nearest_free_equals_a_scan_of_all(seed):
    rng = np.random.default_rng(seed)
    known = [(i, float(x)) for i, x in enumerate(rng.integers(0, 30, rng.integers(0, 60)))]
    events = [(f"e{i}", float(x) / 2) for i, x in enumerate(rng.integers(0, 60, rng.integers(0, 60)))]
    free, want = list(known), []
    for key, seconds in events:
        near = min(free, key=lambda x: abs(x[1] - seconds), default=None)
        if near and abs(near[1] - seconds) <= 4:
            free.remove(near)
            want.append((near[0], key, near[1] - seconds))
    assert alignment.nearest_free(known, events, 4.0) == want


def test_folds_see_each_match_in_order_over_many_batches(spark):
    from scoreline.operators.folds import fold_rows

    def start():
        total = 0

        def step(i, x):
            nonlocal total
            total += x or 0
            return i, total

        return step

    df = spark.createDataFrame([(m, i, None if i % 5 == 0 else i) for m in (3, None, 1, 2) for i in range(500)], "match_id long, i long, x long").repartition(6, "x")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = {(r.match_id, r.i): r.total for r in fold_rows(df, ["match_id"], ["i"], start, "i long, total long").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {(m, i): sum(k for k in range(i + 1) if k % 5) for m in (3, None, 1, 2) for i in range(500)}


def test_a_layout_of_ones_own(spark):
    def fields(text):
        @F.udf("struct<runs:string,bowler:string>", useArrow=True)
        def read(text):
            _, runs, bowler, *_ = text.strip("\x01").split("\x01")
            return runs, bowler

        found = read(text)
        return {"runs": found["runs"], "bowler": found["bowler"], "wickets": F.regexp_extract(text, r"W(\d)", 1)}

    parsers = tokens.with_parser(tokens.Parser("own", lambda t: t.rlike("^\x01SCORE\x01"), fields, "local"))
    assert [p.name for p in parsers] == ["club", "separate", "own", "generic"]
    rows = [(1, ["SCORE", "77", "Roy", "W3"]), (2, ["SCORE", "x", "Roy", "W"]), (3, ["5/1", "2.3", "SCORE"]), (4, ["SCORE", "1-2/3.4(20)", "Roy"])]
    df = spark.createDataFrame(rows, "i int, words array<string>").withColumn("tokens", F.transform("words", lambda w: F.struct(w.alias("text"), F.lit(90.0).alias("conf"))))
    got = {r.i: (r.layout, r.runs, r.wickets, r.bowler) for r in tokens.parse(df, parsers=parsers).collect()}
    assert got == {1: ("own", 77, 3, "Roy"), 2: ("own", None, None, "Roy"), 3: ("generic", 5, 1, None), 4: ("club", 1, 2, None)}
    with pytest.raises(ValueError, match="there is a parser own"):
        tokens.with_parser(parsers[2], parsers)
    with pytest.raises(ValueError, match="no fields of a reading: speed"):
        tokens.parse(df, parsers=tokens.with_parser(tokens.Parser("odd", lambda t: F.lit(True), lambda t: {"speed": t})))


def test_strategy_locks_by_a_layout_or_by_misses(spark):
    def tries(match_id, *frames):
        return [(match_id, i, s, *shown) for i, pair in frames for s, shown in zip(("global", "local"), pair, strict=True) if shown]

    none, generic, scored, club = (None, None), ("generic", None), ("generic", 5), ("club", 7)
    rows = [
        *tries(1, (0, (none, none)), (1, (generic, club)), (2, (scored, club)), (3, (scored, None))),  # locked by a trial of the other way
        *tries(2, (0, (scored, club)), *((i, (none, generic)) for i in range(1, 4)), (7, (scored, club)), (8, (generic, club))),  # by misses: a score keeps the default from being doubted
        *tries(3, (0, (club, None)), (1, (generic, scored))),
    ]
    found = strategy.lock(spark.createDataFrame(rows, "match_id long, frame_index long, strategy string, layout string, runs int").withColumn("wickets", F.lit(None).cast("int")))
    got = {(r.match_id, r.frame_index): (r.locked, r.strategy, r.layout) for r in found.collect()}
    assert [got[1, i] for i in range(4)] == [(False, "global", None), (False, "local", "club"), (True, "local", "club"), (True, "local", None)]
    assert [got[2, i] for i in (0, 1, 3, 7, 8)] == [(False, "global", "generic"), (False, "global", None), (False, "global", None), (False, "global", "generic"), (True, "global", "generic")]
    assert [got[3, i] for i in range(2)] == [(False, "global", "club"), (True, "local", "generic")]


def test_figures_are_counted_by_the_write_itself(spark, tmp_path):
    df = readings(spark, [1, None, 1, 1, 1000, 1, 1], [0.1, 0.2, 0.3, 0.6, 0.0, 1.0, 0.9])
    resolved = smoothing.resolve(df)
    kinds = [*checks.reading_figures(), *checks.smoothing_figures()]
    seen = sinks.write_observed(resolved, f"{tmp_path}/readings", kinds)
    assert seen == pytest.approx(resolved.agg(*kinds).first().asDict())
    assert seen == pytest.approx(spark.read.parquet(f"{tmp_path}/readings").agg(*kinds).first().asDict())
    stats = checks.reading_stats(df).first().asDict()
    assert {k: seen[k] for k in stats if k != "match_id"} == pytest.approx({k: v for k, v in stats.items() if k != "match_id"})
    by_kind = {r.resolution: r.n for r in smoothing.smoothing_stats(resolved).collect()}
    assert {k: seen[f"n_{k}"] for k in ("passed", "outlier", "unusable")} == {k: by_kind.get(k, 0) for k in ("passed", "outlier", "unusable")}
    events = spark.createDataFrame([(1, "SIX", True, 0.5), (1, "SIX", None, 1.0), (2, "FOUR", False, None)], "match_id long, event_type string, is_replay boolean, confidence double")
    assert sinks.write_observed(events, f"{tmp_path}/events", checks.event_figures()) == {"n_four": 1, "n_six": 2, "n_wicket": 0, "n_team_milestone": 0, "n_replays": 1, "mean_confidence": 0.75}


def test_reasons_of_decisions(spark):
    tracker = innings.InningsTracker()
    told = []
    for values in ((150, 6, 19), (None, 0, 0), (60, 1, 0), (5, 0, 7), (0, 0, 0, 0.3), (1, 0, 0), (1, 0, 1)):
        told.append((tracker.observe(*values), tracker.reason))
    assert told == [
        ("NOT_A_CANDIDATE", None), ("NOT_A_CANDIDATE", None),
        ("REJECTED_IMPLAUSIBLE_RESET", "is_decrease=True reset_plausible=False over_ball_reset=False confirmations=0/2"),
        ("REJECTED_NO_OVER_BALL_RESET", "is_decrease=True reset_plausible=True over_ball_reset=False confirmations=0/2"),
        ("REJECTED_INSUFFICIENT_PERSISTENCE", "is_decrease=True reset_plausible=True over_ball_reset=True confirmations=1/4"),
        ("ACCEPTED", "is_decrease=True reset_plausible=True over_ball_reset=True confirmations=2/2"), ("NOT_A_CANDIDATE", None),
    ]
    rows = [("HIGH", "CONSISTENT", "PRESERVED", "UNKNOWN", 0.875), ("UNKNOWN", "UNKNOWN", "VIOLATION", "SUSPICIOUS", None), ("UNKNOWN", "UNKNOWN", "PRESERVED", "UNKNOWN", float("nan")), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "ocr_quality string, score_state string, ordering string, pacing string, ocr_value double")
    assert [r.reason for r in alignment.with_reasons(df).collect()] == [
        "ocr_quality=HIGH(0.88) score_state=CONSISTENT ordering=PRESERVED neighbor_pacing=UNKNOWN", "ocr_quality=UNKNOWN score_state=UNKNOWN ordering=VIOLATION neighbor_pacing=SUSPICIOUS",
        "ocr_quality=UNKNOWN score_state=UNKNOWN ordering=PRESERVED neighbor_pacing=UNKNOWN", None,
    ]


def test_texts_of_a_plan_and_of_a_match(spark):
    segments = spark.createDataFrame([(1, 2, "b.mp4"), (1, 1, "it's/a.mp4"), (2, 1, "c.mp4")], "match_id long, position long, path string")
    assert {r.match_id: r.list for r in clips.concat_list(segments).collect()} == {1: "file 'it'\\''s/a.mp4'\nfile 'b.mp4'", 2: "file 'c.mp4'"}
    figures = spark.createDataFrame([(1, "readings", 12.0), (1, "events_SIX", 1.0), (1, "confidence_SIX", 0.5)], "match_id long, metric string, value double")
    assert report.summary_text(figures).first().summary == "match: 1\nconfidence SIX: 0.500\nevents SIX: 1\nreadings: 12"
