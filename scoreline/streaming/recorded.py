"""A table replayed as a stream, and a stream run to its end: for backfills, and to hold the streaming twins against their batch queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_folder

#: Rows of the whole stream whose matches share a partition of the state; each partition keeps a store of its own open.
ROWS_A_STATE = 1 << 22
#: Rows that may wait in the state at once.
ROWS_A_BATCH = 1 << 22


def arrivals(rows: DataFrame, path: str, pieces: int, late_seconds: float, first: int = 0, last: int | None = None) -> None:
    """Write rows in ``pieces`` files of arrival, one after another, from first to before last, to be read as a stream.

    A row arrives up to late_seconds after its event_time, as a hash of it has it, so that rows come out of order. After the
    last piece comes a row of match -1, ten years on, which lets the watermark pass all others and is never passed itself.
    """
    at = F.unix_micros("event_time") + F.pmod(F.xxhash64(*(c for c, t in rows.dtypes if not t.startswith("map"))), F.lit(int(late_seconds * 1e6) + 1))
    rows = rows.withColumn("__at", at)
    low, high = rows.agg(F.min("__at"), F.max("__at")).first()
    if low is None:
        low = high = 0
    width = (high - low) // pieces + 1
    for piece in range(first, pieces if last is None else last):
        part = rows.filter((F.col("__at") >= low + piece * width) & (F.col("__at") < low + (piece + 1) * width)).drop("__at")
        part.write.mode("append").parquet(path)
    if last is None or last == pieces:
        end = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("match_id"), F.timestamp_micros(F.lit(high + 10 * 365 * 86400 * 10**6)).alias("event_time"))
        end.unionByName(rows.drop("__at").limit(0).withColumn("match_id", F.col("match_id").cast("long")), allowMissingColumns=True).coalesce(1).write.mode("append").parquet(path)


def stream(spark: SparkSession, path: str, like: DataFrame, files: int | None = 64) -> DataFrame:
    """The files that arrivals writes, as a stream of at most so many files a micro-batch, or of all there are."""
    reader = spark.readStream.schema(like.schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def run(found: DataFrame, out: str, checkpoint: str, parts: int | None = None) -> DataFrame:
    """Run a streaming query over all there is, from its checkpoint if it has one, and read what it has written.

    parts is the number of partitions of its state, which a checkpoint keeps from the first run on.
    """
    spark = found.sparkSession
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if parts is not None:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        started = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    started.awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


def replayed(rows: DataFrame, twin: Callable[[DataFrame], DataFrame], pieces: int = 6, late_seconds: float = 300.0) -> DataFrame:
    """What twin makes of the rows when they arrive as a stream, out of order by up to late_seconds.

    A micro-batch has whole pieces, however many files they are: of a piece in three micro-batches, the watermark of the
    first would drop the third. A few rows come in one; of more, the stream goes on from its checkpoint with each piece.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, "stream")
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    n = rows.count()
    parts = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_A_STATE))
    step = pieces if n <= ROWS_A_BATCH else 1
    for first in range(0, pieces, step):
        arrivals(rows, f"{folder}/arrivals", pieces, late_seconds, first, first + step)
        found = run(twin(stream(spark, f"{folder}/arrivals", rows, files=None)), f"{folder}/out", f"{folder}/checkpoint", parts)
    return found
