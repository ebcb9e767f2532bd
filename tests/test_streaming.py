"""The streaming twins: folds over any cut into micro-batches on plain state, and whole streams with restarts and late rows."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scoreline.operators import innings, scenes
from scoreline.streaming import recorded, timeline
from scoreline.streaming.ordered import US, InOrder, fold


pytestmark = pytest.mark.usefixtures("spark")


class State:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return iter(self.value or []) if isinstance(self.value, list) or self.value is None else self.value

    def update(self, value):
        self.value = tuple(value)

    def put(self, rows):
        self.value = list(rows)

    def clear(self):
        self.value = None


class Handle:
    """What a processor asks of Spark, with a watermark of its own."""

    def __init__(self):
        self.states, self.timers = {}, []

    def getListState(self, name, _):
        return self.states.setdefault(name, State())

    def getValueState(self, name, schema):
        StructType.fromDDL(schema)
        return self.states.setdefault(name, State())

    def registerTimer(self, at):
        self.timers.append(at)


class Watermark:
    def __init__(self, us):
        self.us = us

    def getCurrentWatermarkInMs(self):
        return self.us // 1000


def streamed(kind, schema, order, out, rows, rng, late, **settings):
    """Rows in random micro-batches, each up to ``late`` microseconds late, with a new processor on the old state after each."""
    columns = StructType.fromDDL(f"{schema}, {US} long")
    handle, found = Handle(), []
    arrival = sorted(rows, key=lambda r: r[US] + rng.integers(0, late + 1))
    cuts = sorted(rng.integers(0, len(rows) + 1, rng.integers(0, 12)))
    top = watermark = 0
    for part in [*np.split(np.array(arrival, object), cuts), [], []]:
        processor = kind(columns, order, ["match_id", *StructType.fromDDL(out).names], **settings)
        processor.init(handle)
        if len(part):
            assert all(r[US] > watermark for r in part)
            found += processor.handleInputRows((1,), iter([Row(**r) for r in part]), Watermark(watermark))
            top = max(top, *(r[US] for r in part))
        fire, handle.timers = [t for t in handle.timers if t <= watermark // 1000], [t for t in handle.timers if t > watermark // 1000]
        if fire:
            found += processor.handleExpiredTimer((1,), Watermark(watermark), None)
        watermark = max(watermark, (top - late - 1000) // 1000 * 1000)
    processor = kind(columns, order, ["match_id", *StructType.fromDDL(out).names], **settings)
    processor.init(handle)
    found += processor.handleExpiredTimer((1,), Watermark(10**16), None)
    return [tuple(r)[1:] for r in found], handle


def readings(rng, n):
    """Scores that rise and fall so that every outcome of tracker and validator occurs."""
    rows, runs, wickets, us = [], 0, 0, 10**9
    for i in range(n):
        us += int(rng.integers(0, 3)) * 100_000
        if rng.random() < 0.06:
            runs, wickets = int(rng.integers(0, 40)), int(rng.integers(0, 5))
        else:
            runs, wickets = runs + int(rng.integers(0, 7)), wickets + int(rng.random() < 0.1)
        hide = rng.random(5) < 0.07
        over = [i // 12 % 52, int(rng.integers(0, 2)), int(rng.integers(0, 60))][rng.choice(3, p=[0.5, 0.45, 0.05])]
        ball = int(rng.integers(0, 9)) if rng.random() < 0.2 else i // 2 % 6
        values = [None if h else v for h, v in zip(hide, [runs, wickets, over, ball, "P"], strict=True)]
        rows.append({"reading_id": i, "timestamp_seconds": us / 1e6, **dict(zip(["runs", "wickets", "over_number", "ball_in_over", "batter"], values, strict=True)), "confidence": [None, 0.3, 0.9][rng.integers(3)], US: us})
    return rows


READING = "reading_id long, timestamp_seconds double, runs int, wickets int, over_number int, ball_in_over int, batter string, confidence double"


@pytest.mark.parametrize("seed", range(12))
def test_tracker_and_validator_give_the_same_in_any_batches(seed):
    rng = np.random.default_rng(seed)
    rows = readings(rng, 150)
    want_tags, want_reasons, tracker, validator = [], [], innings.InningsTracker(), innings.ReadingValidator()
    for r in rows:
        want_tags.append((r["reading_id"], tracker.observe(r["runs"], r["wickets"], r["over_number"], r["confidence"]), tracker.segment))
        reason = validator.check(r["runs"], r["wickets"], r["over_number"], r["ball_in_over"], r["batter"])
        want_reasons.append((r["reading_id"], reason, 0.0 if reason else 1.0))
    order = ("timestamp_seconds", "reading_id")
    tags, _ = streamed(timeline.Tagger, READING, order, "reading_id long, decision string, segment int", rows, rng, 2_000_000, config=innings.TrackerConfig())
    reasons, _ = streamed(timeline.Validator, READING, order, "reading_id long, reason string, parse_confidence double", rows, rng, 2_000_000)
    assert (tags, reasons) == (want_tags, want_reasons)


def test_the_readings_above_reach_every_outcome():
    decisions, reasons = set(), set()
    for seed in range(12):
        tracker, validator = innings.InningsTracker(), innings.ReadingValidator()
        for r in readings(np.random.default_rng(seed), 150):
            decisions.add(tracker.observe(r["runs"], r["wickets"], r["over_number"], r["confidence"]))
            reasons.add(validator.check(r["runs"], r["wickets"], r["over_number"], r["ball_in_over"], r["batter"]))
    assert decisions == {innings.NOT_A_CANDIDATE, innings.ACCEPTED, innings.IMPLAUSIBLE, innings.NO_OVER_BALL, innings.NOT_PERSISTENT, innings.TOO_MANY}
    assert reasons == {None, "INVALID_BALL_NUMBER", "WICKETS_DECREASED", "INVALID_OVER_SEQUENCE", "RUNS_DECREASED"}
    assert innings.ReadingValidator().check(None, None, None, None, None) == "PLAYER_PARSE_FAILED"


@pytest.mark.parametrize("seed", range(12))
def test_outliers_in_any_batches(seed):
    rng = np.random.default_rng(seed)
    window, us, rows = int(rng.integers(1, 4)), 10**9, []
    for i in range(int(rng.integers(0, 90)) + 1):
        us += int(rng.integers(1, 4)) * 100_000
        core = [int(i // 9), None, 5, 2] if rng.random() < 0.85 else [int(i // 9), 1, int(rng.integers(9)), 2]
        rows.append({"reading_id": i, "timestamp_seconds": us / 1e6, **dict(zip(["over_number", "ball_in_over", "runs", "wickets"], core, strict=True)), "bad": bool(rng.random() < 0.2), US: us})
    usable = [r for r in rows if not r["bad"]]
    want = {r["reading_id"]: "unusable" for r in rows if r["bad"]}
    for i, r in enumerate(usable):
        near = [tuple(x[c] for c in timeline.CORE) for x in usable[max(0, i - window) : i] + usable[i + 1 : i + window + 1]]
        own = tuple(r[c] for c in timeline.CORE)
        want[r["reading_id"]] = "outlier" if len(near) == 2 * window and i >= window and len(set(near)) == 1 and own != near[0] else "passed"
    schema = "reading_id long, timestamp_seconds double, over_number int, ball_in_over int, runs int, wickets int, bad boolean"
    found, handle = streamed(timeline.Resolver, schema, ("timestamp_seconds", "reading_id"), "reading_id long, resolution string", rows, rng, 1_000_000, window=window, quiet_seconds=3600.0)
    assert len(found) == len(want) and dict(found) == want
    assert handle.states["held"].value is None


@pytest.mark.parametrize("seed", range(12))
def test_clips_in_any_batches_and_state_of_the_open_clip_alone(seed):
    rng = np.random.default_rng(seed)
    gap, rows, start = float(rng.integers(0, 4)), [], 1000.0
    for i in range(int(rng.integers(1, 80))):
        start += float(rng.integers(0, 8)) / 2
        rows.append({"clip_start": start, "clip_end": start + float(rng.integers(0, 10)) / 2, "timestamp_seconds": start, "event_key": f"e{i:03}", "is_replay": bool(rng.random() < 0.2) or None, US: int(start * 1e6)})
    want, frontier = [], None
    for r in sorted(rows, key=lambda r: (r["clip_start"], r["clip_end"])):
        if frontier is None or r["clip_start"] - frontier > gap:
            want.append([len(want), [], r["clip_start"], 0.0, False])
            frontier = r["clip_end"]
        frontier = max(frontier, r["clip_end"])
        want[-1][1].append(r["event_key"])
        want[-1][3:] = [frontier, want[-1][4] or bool(r["is_replay"])]
    schema = "clip_start double, clip_end double, timestamp_seconds double, event_key string, is_replay boolean"
    order = ("clip_start", "clip_end", "timestamp_seconds", "event_key")
    out = "island long, clip_id string, start_seconds double, end_seconds double, n_events long, merged boolean, is_replay boolean"
    found, handle = streamed(timeline.Merger, schema, order, out, rows, rng, 2_000_000, gap=gap)
    assert found == [(i, "+".join(sorted(k)), a, b, len(k), len(k) > 1, r) for i, k, a, b, r in want]
    assert handle.states["held"].value[1:] == (len(want), None, None, [], False, None)


FRAME = "frame_index long, timestamp_seconds double, score double, cuts array<long>"
CUT = "frame_index long, timestamp_seconds double, score double, boundary_type string, confidence double"


@pytest.mark.parametrize("delay", [0, 1, 2, 3, 7, 31, 32, 40])
def test_late_cuts_do_not_depend_on_their_delay(delay):
    rng = np.random.default_rng(delay)
    scores = np.round(rng.random(200) * 20, 3)
    cuts = sorted(set(map(int, rng.integers(0, 200, 40))))
    rows = [{"frame_index": i, "timestamp_seconds": i / 10, "score": float(s), "cuts": None, US: 10**9 + i * 100_000} for i, s in enumerate(scores)]
    for cut in cuts:
        at = rows[min(cut + delay, 199)]
        at["cuts"] = [*(at["cuts"] or []), cut]
    want, last = [], None
    for cut in cuts:
        if last is None or cut > last + 3:
            want.append((cut, cut / 10, float(scores[cut]), *scenes.classify(float(scores[cut]), [float(x) for x in scores[cut + 1 : cut + 4]])))
            last = cut
    found, _ = streamed(timeline.LateCuts, FRAME, ("frame_index",), CUT, rows, rng, 700_000, reach=3, quiet_seconds=60.0)
    if delay < timeline.LOOK_BACK:
        assert sorted(found) == want
    else:  # out of the buffer: the time and score of the frame that reports
        assert [f[0] for f in found] == [w[0] for w in want]
        assert all(f[1] == min(f[0] + delay, 199) / 10 for f in found if f[0] + delay <= 199)


def timed(df):
    return df.withColumn("event_time", F.timestamp_micros((F.col("timestamp_seconds") * 1e6).cast("long") + 10**15))


def test_a_stream_stopped_and_gone_on_from_its_checkpoint(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [{"match_id": m, **{k: v for k, v in r.items() if k != US}} for m in (1, 2, 3) for r in readings(rng, 60)]
    schema = "match_id long, " + READING
    df = timed(spark.createDataFrame([tuple(r[c] for c in StructType.fromDDL(schema).names) for r in rows], schema)).withColumnRenamed("confidence", "ocr_confidence")
    df.write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    for first, last in ((0, 2), (2, 3), (3, 5)):
        recorded.arrivals(df, f"{tmp_path}/arrivals", 5, 3.0, first, last)
        found = recorded.run(timeline.tag_innings(recorded.stream(spark, f"{tmp_path}/arrivals", df), delay="4 seconds"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        if last < 5:
            assert found.count() < len(rows)
    want = innings.tag_innings(df)
    assert found.count() == len(rows) and found.exceptAll(want).isEmpty()


def test_late_rows_are_dropped_and_change_nothing(spark, tmp_path):
    rows = [(1, i, float(i), i, 0, 0, 1, "P", 0.9) for i in range(20)]
    schema = "match_id long, reading_id long, timestamp_seconds double, runs int, wickets int, over_number int, ball_in_over int, batter string, ocr_confidence double"
    path = f"{tmp_path}/arrivals"
    df = timed(spark.createDataFrame(rows, schema))
    df.filter("reading_id <> 3").write.parquet(path)

    def run():
        return recorded.run(timeline.validate_readings(recorded.stream(spark, path, df), delay="1 second"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")

    run()
    df.filter("reading_id = 3").write.mode("append").parquet(path)
    recorded.arrivals(df.limit(0), path, 1, 0.0)
    found = run()
    later = df.filter("reading_id = 3").withColumn("event_time", F.timestamp_micros(F.lit(3 * 10**15)))
    later.write.mode("append").parquet(path)
    found = run()
    want = innings.validate_readings(df.filter("reading_id <> 3"))
    assert found.exceptAll(want).isEmpty() and found.count() == 19


def test_rows_come_in_frames_with_their_nulls_and_whole_numbers(spark, tmp_path):
    """Numbers are null in some rows alone, beyond 2^53, and NaN; waiting rows keep all of that."""

    class Echo(InOrder):
        state = "n int"

        def take(self, held, row):
            return ((held or (0,))[0] + 1,), [(row.i, row.x, row.flag, row.name, row.many, (held or (0,))[0])]

    schema = "match_id long, i long, x double, flag boolean, name string, many array<long>, at double"
    rows = [(k, i, x, flag, name, many, 1000.0 + n) for k in (1, None) for n, (i, x, flag, name, many) in enumerate([(2**60 + 1, float("nan"), None, "a", [1, None]), (None, None, True, None, None), (3, 0.5, False, "b", [])])]
    stamped = spark.createDataFrame(rows, schema).withColumn("event_time", F.timestamp_seconds("at"))
    out = "i long, x double, flag boolean, name string, many array<long>, n int"
    found = recorded.replayed(stamped, lambda s: fold(s, Echo, ["i", "x", "flag", "name", "many"], (), out, "10 minutes"), pieces=2, late_seconds=1.0)
    got = sorted((tuple(r) for r in found.filter("match_id is null or match_id >= 0").collect()), key=lambda r: (r[0] is None, r[6]))
    assert repr([r[:6] for r in got]) == repr([r[:6] for r in rows])
    assert [r[6] for r in got] == [0, 1, 2] * 2


def test_pieces_of_many_files_lose_no_rows(spark, monkeypatch):
    """A piece of three micro-batches would have its third part behind the watermark of its first."""
    monkeypatch.setattr(recorded, "ROWS_A_BATCH", 10, raising=False)
    rows = [(m, 100 * m + i, 3600.0 * i + m, i, 0, 0, 1, "P", 0.9) for m in range(1400) for i in range(6)]
    schema = "match_id long, reading_id long, timestamp_seconds double, runs int, wickets int, over_number int, ball_in_over int, batter string, ocr_confidence double"
    df = timed(spark.createDataFrame(rows, schema)).repartition(140, "match_id")
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(c) for c in sizes]
    for c in sizes:
        spark.conf.set(c, "4m")
    try:
        found = recorded.replayed(df, timeline.validate_readings, pieces=1, late_seconds=60.0)
    finally:
        for c, v in zip(sizes, before, strict=True):
            spark.conf.set(c, v)
    assert sorted(r.reading_id for r in found.filter("match_id >= 0").collect()) == sorted(r[1] for r in rows)
