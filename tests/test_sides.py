"""Innings that have one side of the comparison alone, and ranks of candidates without pairs in a shuffle."""

import duckdb
from pyspark.sql import functions as F

from scoreline.functions import scalar
from scoreline.operators import alignment, replay, report
from scoreline.sources import event_feed as feed

TRUTH = "match_id long, innings int, over_number int, ball_in_over int, event_type string, description string, truth_id long"
READINGS = "match_id long, innings int, timestamp_seconds double, reading_id long, over_number int, ball_in_over int, runs int, wickets int, ocr_confidence double, parse_confidence double"
DETECTED = "match_id long, innings int, event_type string, timestamp_seconds double, event_key string"


def sides(spark, detected):
    truth = spark.createDataFrame([(1, 1, 0, 1, "FOUR", "FOUR, Smith", 10), (2, 2, 0, 1, "SIX", "a SIX", 20)], TRUTH)
    readings = spark.createDataFrame([(1, 1, 5.0, 100, 0, 1, 4, 0, 0.9, 1.0), (3, 1, 5.0, 300, 0, 1, 4, 0, 0.9, 1.0), (None, 1, 5.0, 400, 0, 1, 4, 0, 0.9, 1.0)], READINGS)
    return alignment.reconcile(truth, readings, spark.createDataFrame(detected, DETECTED))


def test_innings_with_one_side(spark):
    found = sides(spark, [(1, 1, "FOUR", 6.0, "1:0.1:FOUR"), (3, 1, "WICKET", 7.0, "1:0.2:WICKET"), (3, 1, "TEAM_MILESTONE", 7.0, "m")])
    rows = sorted((r.match_id, r.side, r.outcome, r.event_key, r.truth_id, r.description) for r in found.collect())
    assert rows == [
        (1, "commentary", "TRUE_POSITIVE", "1:0.1:FOUR", 10, "FOUR, Smith"),
        (1, "detected", "TRUE_POSITIVE", "1:0.1:FOUR", None, None),
        (2, "commentary", "UNRECOVERABLE_MISS", None, 20, "a SIX"),
        (3, "detected", "FALSE_POSITIVE", "1:0.2:WICKET", None, None),
    ]
    assert [tuple(r) for r in report.false_positives(found).collect()] == [(3, 1, "WICKET", "1:0.2:WICKET")]


def test_only_detected_events(spark):
    found = sides(spark, [(3, 1, "WICKET", 7.0, "w"), (3, 1, "WICKET", 8.0, "v")]).filter("match_id = 3")
    assert sorted((r.event_key, r.outcome, r.tier) for r in found.collect()) == [("v", "FALSE_POSITIVE", None), ("w", "FALSE_POSITIVE", None)]


def test_candidates_are_ranked_within_their_over(spark, data):
    ranked = alignment.rank_candidates(alignment.ground_truth(feed.commentary(spark, data)), feed.readings(spark, data))
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[: plan.index("Join")]
    assert "Window" not in joined and "Aggregate" not in joined


def test_names_of_matches_with_large_ids(spark, tmp_path, data):
    moved = spark.read.parquet(f"{data}/events.parquet").withColumn("user_id", F.col("user_id") + 6 * 10**12)
    moved.write.parquet(f"{tmp_path}/events.parquet")
    names = [sorted(r.description for r in feed.commentary(spark, str(d)).select("description").collect()) for d in (data, tmp_path)]
    assert names[0] == names[1]


def test_partitions_grow_with_the_events(spark, data, monkeypatch):
    monkeypatch.setattr(feed, "EVENTS_A_PART", 10)
    n = spark.read.parquet(f"{data}/events.parquet").count()
    few = feed.readings(spark, data, gaps=True)
    assert few.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-n // 10))
    monkeypatch.undo()
    assert feed.readings(spark, data).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_means_of_segments_follow_from_the_frames_alone(spark):
    segments = spark.createDataFrame([(1, 0, 0.0, 10.0, 0.5, "ORDINARY_CUT")], "match_id long, segment_id int, start_seconds double, end_seconds double, boundary_confidence double, boundary_type string")
    values = [0.1, 1e16, 0.7, -1e16, 0.3]
    rows = [(1, float(i), *[v] * 5) for i, v in enumerate(values)]
    schema = "match_id long, timestamp_seconds double, " + ", ".join(f"{c} double" for c in replay.MEASURES)
    found = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        for parts in (1, 5):
            found.add(tuple(replay.segment_evidence(spark.createDataFrame(order, schema).repartition(parts), segments).select("n_frames", *replay.MEASURES).first()))
    assert found == {(5, *[sum_in_order(values) / 5] * 5)}


def sum_in_order(values):
    total = 0.0
    for v in values:
        total += v
    return total


def test_scores_are_added_one_after_another(spark):
    signals = (0.11, 0.5, 0.5, 0.1, 0.5)
    plain = 0.0
    for w, v in zip(replay.WEIGHTS.values(), signals, strict=True):
        plain += w * v
    assert plain != sum(w * v for w, v in zip(replay.WEIGHTS.values(), signals, strict=True))
    schema = "match_id long, segment_id int, start_seconds double, end_seconds double, n_frames long, logo double, scoreboard double, motion double, intensity double, contrast double, boundary_confidence double, boundary_type string"
    row = spark.createDataFrame([(1, 0, 0.0, 9.0, 1, signals[0], 1.0, 1.0, 1.0, 1.0, signals[3], "REPLAY_TRANSITION")], schema)
    assert replay.score_segments(row).first().score == plain


def test_outcomes_follow_from_the_segments_alone(spark):
    lengths = [0.1, 1e16, 0.7, -1e16, 0.3]
    rows = [(1, i, 0.0, v, v, True) for i, v in enumerate(lengths)] + [(1, 9, 0.0, 5.0, 0.2, False), (2, 0, 0.0, 5.0, 0.2, False)]
    schema = "match_id long, segment_id int, start_seconds double, end_seconds double, score double, is_replay boolean"
    found = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        found |= {tuple(r) for r in replay.outcomes(spark.createDataFrame(order, schema).repartition(5)).collect()}
    assert found == {(1, 5, 1, sum_in_order(lengths) / 5, 1e16, 1e16, sum_in_order(lengths)), (2, 0, 1, None, None, None, 0.0)}


def test_rounding_is_that_of_sql(spark):
    values = [3215817.4773969483, 0.1234567895, -0.1234567895, 2.5e-9, -1.5e-9, 157680000.12345678, 86888.733543009, 1e300, float("inf"), None, 0.0]
    values += [i * 1234.567890123 for i in range(2000)]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "x double").select(scalar.rounded(F.col("x"), 9).alias("x")).collect()]
    want = [r[0] for r in duckdb.execute("select round(x, 9) from (select unnest($v::double[]) as x)", {"v": values}).fetchall()]
    assert got == want
