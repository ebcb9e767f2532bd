import json

import pytest
from pyspark.sql import functions as F

from scoreline import queries
from scoreline.operators import repair
from scoreline.sources import constraints, sinks, store

EVENT = "match_id long, event_id long, timestamp_seconds double, innings int, over_number int, ball_in_over int, event_type string, event_key string, confidence double, is_replay boolean"
ALIGNED = "match_id long, innings int, over_number int, ball_in_over int, event_type string, description string, truth_id long, anchor_seconds double, event_key string, recovery_eligible boolean"


@pytest.fixture
def stored(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, 10.0, 1, 0, 1, "WICKET", "1:0.1:WICKET", 0.9, False), (2, 1, 5.0, 1, 0, 1, "FOUR", "1:0.1:FOUR", 0.9, False), (3, 1, 5.0, 1, 0, 1, "SIX", "1:0.1:SIX", 0.9, True)], EVENT)
    readings = spark.createDataFrame([(m, i, float(i), i) for m in (1, 2, 3) for i in range(4)], "match_id long, reading_id long, timestamp_seconds double, runs int")
    store.write(f"{tmp_path}/store", events=events, readings=readings)
    return f"{tmp_path}/store"


@pytest.fixture
def aligned(spark):
    rows = [
        (1, 1, 0, 1, "WICKET", "OUT c Ali b Roy", 11, 10.0, "1:0.1:WICKET", False), (1, 1, 2, 3, "FOUR", "FOUR", 12, 30.0, None, True), (1, 1, 3, 0, "WICKET", "OUT b Roy", 13, 40.0, None, True),
        (2, 1, 4, 4, "SIX", "SIX", 14, None, None, False),
    ]
    return spark.createDataFrame(rows, ALIGNED)


def found(spark, path, kind, *columns):
    return sorted(tuple(r) for r in store.read(spark, path, kind).select(*columns).collect())


def files(spark, path):
    return {(r.match_id, r.name) for r in spark.read.schema(store.schema()).parquet(path).select("match_id", F.input_file_name().alias("name")).collect()}


def test_round_trip(spark, stored):
    assert found(spark, stored, "events", "match_id", "event_key", "source", "team") == [(1, "1:0.1:WICKET", "OCR", None), (2, "1:0.1:FOUR", "OCR", None), (3, "1:0.1:SIX", "OCR", None)]
    assert len(found(spark, stored, "readings", "match_id", "runs")) == 12 and found(spark, stored, "operations", "match_id") == []
    assert store.read(spark, stored, "replays").columns == store.columns_of("replays")
    assert sorted(tuple(r) for r in store.analyses(spark, stored).select("match_id", "readings", "events", "schema_version").collect()) == [(1, 4, 1, 2), (2, 4, 1, 2), (3, 4, 1, 2)]


def test_repair_writes_events_and_audit_together_and_once(spark, stored, aligned):
    before = files(spark, stored)
    store.repair_match(spark, stored, aligned)
    events = [(1, 1, "1:0.1:WICKET", "OCR", "CAUGHT"), (1, 2, "1:2.3:FOUR", "METADATA", None), (1, 3, "1:3.0:WICKET", "METADATA", "BOWLED"), (2, 1, "1:0.1:FOUR", "OCR", None), (3, 1, "1:0.1:SIX", "OCR", None)]
    assert found(spark, stored, "events", "match_id", "event_id", "event_key", "source", "dismissal_type") == events
    operations = found(spark, stored, "operations", "match_id", "metadata_id", "operation", "event_key")
    assert operations == [
        (1, "1:0.1:WICKET:11", "ENRICHMENT", "1:0.1:WICKET"), (1, "1:2.3:FOUR:12", "RECOVERY", "1:2.3:FOUR"), (1, "1:3.0:WICKET:13", "ENRICHMENT", "1:3.0:WICKET"), (1, "1:3.0:WICKET:13", "RECOVERY", "1:3.0:WICKET"),
    ]
    assert len(found(spark, stored, "readings", "match_id")) == 12
    after = files(spark, stored)
    assert {f for f in before if f[0] != 1} == {f for f in after if f[0] != 1}
    store.repair_match(spark, stored, aligned)
    assert files(spark, stored) == after


def test_a_failure_in_between_leaves_neither(spark, stored, aligned, monkeypatch):
    before, state = files(spark, stored), found(spark, stored, "events", "match_id", "event_key")
    true = store.write

    def failing(path, **tables):
        bad = F.when(F.col("metadata_id").isNotNull(), F.raise_error(F.lit("lost"))).otherwise(F.col("operation"))
        true(path, **tables | {"operations": tables["operations"].withColumn("operation", bad)})

    monkeypatch.setattr(store, "write", failing)
    with pytest.raises(Exception, match="lost"):
        store.repair_match(spark, stored, aligned)
    assert files(spark, stored) == before and found(spark, stored, "events", "match_id", "event_key") == state
    monkeypatch.setattr(store, "write", true)
    store.repair_match(spark, stored, aligned)
    assert len(found(spark, stored, "events", "match_id")) == 5


def test_recovery_and_enrichment_meet_a_filled_audit(spark, aligned):
    audit = spark.createDataFrame([(1, "1:2.3:FOUR:12", "RECOVERY", "1:2.3:FOUR"), (1, "1:3.0:WICKET:13", "RECOVERY", "1:3.0:WICKET"), (1, "1:0.1:WICKET:11", "ENRICHMENT", "1:0.1:WICKET")], "match_id long, metadata_id string, operation string, event_key string")
    assert repair.recover(aligned, audit)[0].count() == 0
    _, done = repair.enrich(aligned, spark.createDataFrame([], EVENT), audit)
    assert [tuple(r) for r in done.collect()] == [(1, "1:3.0:WICKET:13", "ENRICHMENT", "1:3.0:WICKET")]


def test_clip_windows_touch_their_own_matches(spark, stored):
    before = files(spark, stored)
    store.update_clips(spark, stored, spark.createDataFrame([(2, 1, 1.0, 9.0)], "match_id long, event_id long, new_start double, new_end double"))
    assert found(spark, stored, "events", "match_id", "clip_start", "clip_end")[1] == (2, 1.0, 9.0)
    assert {f for f in before if f[0] != 2} == {f for f in files(spark, stored) if f[0] != 2}
    assert len(found(spark, stored, "readings", "match_id")) == 12


def test_only_partitions_of_wanted_matches_are_read(spark, stored, tmp_path):
    spark.createDataFrame([(1, "COMPLETE"), (2, "FAILED"), (3, "COMPLETE")], "match_id long, status string").write.parquet(f"{tmp_path}/log")
    wanted = spark.read.parquet(f"{tmp_path}/log").filter("status = 'COMPLETE'")
    rows = store.read(spark, stored, "events", wanted)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert sorted(r.match_id for r in rows.collect()) == [1, 3]


def test_versions(spark, stored):
    old = spark.createDataFrame([("events", 1, 7.0, "FOUR", "1:1.1:FOUR", 9)], "kind string, event_id long, timestamp_seconds double, event_type string, event_key string, match_id long")
    old.write.mode("append").partitionBy("match_id").parquet(stored)
    assert found(spark, stored, "events", "match_id", "event_key", "source")[-1] == (9, "1:1.1:FOUR", "OCR")
    assert [r.schema_version for r in store.analyses(spark, stored).orderBy("match_id").collect()] == [2, 2, 2, 1]
    old.withColumns({"schema_version": F.lit(3), "match_id": F.lit(10)}).write.mode("append").partitionBy("match_id").parquet(stored)
    with pytest.raises(Exception, match="unknown schema version: 3"):
        store.read(spark, stored, "events").collect()


def test_constraints(spark):
    rows = [(1, 1, 1.0, "FOUR", "a", 0.5, False), (1, 1, float("nan"), "FIVE", None, 1.5, None), (1, None, None, None, "c", None, True), (2, None, 2.0, "SIX", "d", 0.0, True), (2, None, 2.0, "SIX", "d", 1.0, True)]
    events = spark.createDataFrame(rows, "match_id long, event_id long, timestamp_seconds double, event_type string, event_key string, confidence double, is_replay boolean")
    got = sorted((r.event_key or "", r.constraint) for r in constraints.violations(events, constraints.TABLES["events"]).collect())
    assert got == [
        ("", "confidence is out of range"), ("", "event_key is null"), ("", "event_type is unknown"), ("", "is_replay is null"), ("", "match_id, event_id not unique"), ("", "timestamp_seconds is not finite"),
        ("a", "match_id, event_id not unique"), ("c", "timestamp_seconds is null"),
    ]
    assert constraints.required(events.filter("match_id = 2"), constraints.TABLES["events"]).count() == 2
    with pytest.raises(Exception, match="constraint broken: .*(null|unique)"):
        constraints.required(events, constraints.TABLES["events"]).collect()


@pytest.mark.parametrize("name", sorted(constraints.TABLES))
def test_every_table_has_constraints_that_compile(spark, name):
    types = {"match_id": "long", "is_replay": "boolean", "event_id": "long", "reading_id": "long"}
    texts = {"source_path", "file_hash", "status", "event_type", "event_key", "source", "dismissal_type", "operation", "metadata_id", "boundary_type"}
    known = [*types, *texts, "timestamp_seconds", "start_seconds", "end_seconds", "clip_start", "clip_end", "confidence", "ocr_confidence", "parse_confidence", "duration_seconds"]
    rows = spark.createDataFrame([tuple(None for _ in known)] * 2, ", ".join(f"{c} {types.get(c, 'string' if c in texts else 'double')}" for c in known))
    broken = {r.constraint for r in constraints.violations(rows, constraints.TABLES[name]).collect()}
    assert broken == {f"{c} is null" for c in constraints.TABLES[name].not_null}


def test_export_of_a_stored_analysis(spark, stored, tmp_path):
    sinks.export_json(store.read(spark, stored, "events"), store.read(spark, stored, "readings"), f"{tmp_path}/out")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert sorted(line["match_id"] for line in lines) == [1, 2, 3] and all(len(line["scoreboard_readings"]) == 4 for line in lines)


def test_a_store_of_blocks_holds_what_a_store_of_matches_does(spark, stored, aligned, tmp_path):
    path, blocks = f"{tmp_path}/blocks", 2
    kinds = {kind: store.staged(store.read(spark, stored, kind)) for kind in ("events", "readings")}
    store.write(path, blocks, **kinds)
    updates = spark.createDataFrame([(2, 1, 1.0, 9.0)], "match_id long, event_id long, new_start double, new_end double")
    for folder, n in ((stored, None), (path, blocks)):
        store.repair_match(spark, folder, aligned, n)
        store.repair_match(spark, folder, aligned, n)
        store.update_clips(spark, folder, updates, n)
    for kind in store.KINDS:
        want, got = store.read(spark, stored, kind), store.read(spark, path, kind, blocks=blocks)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    one = spark.createDataFrame([(2,)], "match_id long")
    assert sorted(r.match_id for r in store.read(spark, path, "events", one, blocks).collect()) == [2]
    assert sorted(map(tuple, store.analyses(spark, path, blocks).collect())) == sorted(map(tuple, store.analyses(spark, stored).collect()))


def test_files_of_the_repaired_store_do_not_grow_with_its_matches(spark, data):
    path = queries._repaired(spark, data)
    path = path if isinstance(path, str) else path[0]
    found = spark.read.parquet(path).select("match_id", F.input_file_name().alias("name")).distinct()
    assert found.select("match_id").distinct().count() > spark.sparkContext.defaultParallelism >= found.select("name").distinct().count()
