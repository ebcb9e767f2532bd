import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from scoreline.sources import frames, providers
from scoreline.sources.commentary import read_commentary


def innings(*parts):
    return {"innings": [{"innings": n, "commentary": [{"ball": b, "description": d} for b, d in balls]} for n, balls in parts]}


@pytest.fixture
def folder(spark, tmp_path):
    providers.register(spark)
    for match_id in (3, 7, 11):
        (tmp_path / f"{match_id}.json").write_text(json.dumps(innings((1, [("0.1", "FOUR, é"), ("0.2", "OUT")]), (2, [("0.1", f"SIX {match_id}")]))))
    (tmp_path / "notes.txt").write_text("not a commentary")
    return str(tmp_path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_same_rows_as_the_scan_of_files(spark, folder):
    assert rows(spark.read.format("ball_commentary").load(f"{folder}/7.json")) == rows(read_commentary(spark, f"{folder}/7.json", 7))
    found = providers.extract(spark, folder)
    assert found.count() == 9 and rows(found.select("match_id").distinct()) == [(3,), (7,), (11,)]
    assert providers.extract(spark, f"{folder}/3.json", lambda s, p: read_commentary(s, p, 3)).count() == 3


@pytest.mark.parametrize(("condition", "files"), [("match_id = 7", 1), ("match_id in (3, 11, 12)", 2), ("match_id > 3", 2), ("match_id >= 7 and match_id < 11", 1), ("match_id = 7 and ball = '0.2'", 1), ("match_id % 2 = 1", 3)])
def test_filters_leave_files_unread(spark, folder, condition, files):
    df = spark.read.format("ball_commentary").load(folder).filter(condition)
    assert df.rdd.getNumPartitions() == files
    assert rows(df) == rows(spark.createDataFrame(rows(spark.read.format("ball_commentary").load(folder)), providers.COMMENTARY).filter(condition))


def test_nothing_is_read_where_filters_leave_nothing(spark, folder):
    (spark.read.format("ball_commentary").load(folder).filter("match_id = 4").count() == 0) or pytest.fail()
    with open(f"{folder}/8.json", "w") as f:
        f.write("{")
    assert spark.read.format("ball_commentary").load(folder).filter("match_id <> 8 and match_id < 8").count() == 6


@pytest.mark.parametrize("text", ["{", "[]", '{"innings": [{"innings": 1}]}', '{"innings": [{"innings": "1", "commentary": []}]}', '{"innings": [{"innings": 1, "commentary": [{"ball": "0.1", "description": "ok"}, {"ball": 2, "description": "x"}]}]}'])
def test_a_malformed_file_is_an_error_and_never_part_of_a_result(spark, folder, text):
    with open(f"{folder}/9.json", "w") as f:
        f.write(text)
    with pytest.raises(providers.CommentaryError, match="9.json"):
        providers.delivery_rows(f"{folder}/9.json", 9)
    with pytest.raises(Exception, match="CommentaryError"):
        spark.read.format("ball_commentary").load(folder).collect()


def test_a_missing_path_is_an_error(spark, folder):
    with pytest.raises(Exception, match="nothing is there to read"):
        spark.read.format("ball_commentary").load(f"{folder}/none").collect()


@pytest.fixture
def videos(spark, tmp_path):
    providers.register(spark)
    spark.createDataFrame([(1, 100, 25.0), (2, 7, 29.97), (3, 0, 25.0), (4, 1, 10.0)], "match_id long, frame_count long, fps double").coalesce(1).write.parquet(f"{tmp_path}/videos")
    return f"{tmp_path}/videos"


@pytest.mark.parametrize("rate", [None, 3.0, 7.5, 60.0])
def test_plans_equal_those_of_expressions(spark, videos, rate):
    reader = spark.read.format("frame_plan").option("frames", 5)
    found = (reader if rate is None else reader.option("rate", rate)).load(videos)
    table = spark.read.parquet(videos)
    want = frames.every_frame(table) if rate is None else frames.at_rate(table, rate)
    assert rows(found.select("match_id", "frame_index")) == rows(want.select("match_id", F.col("frame_index").cast("long")))
    assert all(r.timestamp_seconds == r.frame_index / 25.0 for r in found.filter("match_id = 1").collect())


def test_filters_leave_ranges_out(spark, videos):
    plan = spark.read.format("frame_plan").option("frames", 10).load(videos)
    assert plan.rdd.getNumPartitions() == 12
    some = plan.filter("match_id = 1 and frame_index between 25 and 44")
    assert some.rdd.getNumPartitions() == 3 and [r.frame_index for r in some.orderBy("frame_index").collect()] == list(range(25, 45))
    assert rows(plan.filter("frame_index in (3, 99, 100)").select("match_id", "frame_index")) == [(1, 3), (1, 99), (2, 3)]
    assert plan.filter("match_id = 3").count() == 0


class Own(DataSource):
    @classmethod
    def name(cls):
        return "own_commentary"

    def schema(self):
        return providers.COMMENTARY

    def reader(self, schema):
        class Reader(DataSourceReader):
            def read(self, partition):
                yield 1, 1, "0.1", "FOUR", 1

        return Reader()


def test_a_provider_of_ones_own(spark):
    providers.register(spark, Own)
    assert rows(providers.extract(spark, "", "own_commentary")) == [(1, 1, "0.1", "FOUR", 1)]
