"""Ball-by-ball commentary from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMBINED = "innings array<struct<innings:int, commentary:array<struct<ball:string, description:string>>>>"
PER_INNINGS = "match_info string, commentary array<struct<over:string, event:string, detail:string>>"


def read_commentary(spark: SparkSession, path: str, match_id: int | None = None) -> DataFrame:
    """match_id, innings, ball, description, delivery_id of every delivery; malformed files are an error, never part of a result."""
    files = spark.read.json(path, schema=COMBINED, multiLine=True, mode="FAILFAST")
    deliveries = files.select(F.lit(match_id).cast("long").alias("match_id"), F.explode("innings").alias("i")).select("match_id", "i.innings", F.posexplode("i.commentary").alias("pos", "d"))
    return deliveries.select("match_id", "innings", "d.ball", "d.description", (F.col("innings") * 1_000_000 + F.col("pos")).alias("delivery_id"))


def combine_innings(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two files of the per-innings form (over, event, detail) to rows of the combined form."""
    parts = [df.select(F.lit(n).alias("innings"), F.explode("commentary").alias("d")) for n, df in ((1, first), (2, second))]
    rows = parts[0].unionByName(parts[1])
    return rows.select("innings", F.col("d.over").alias("ball"), F.concat_ws(", ", "d.event", "d.detail").alias("description"))


def read_innings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=PER_INNINGS, multiLine=True, mode="FAILFAST")
