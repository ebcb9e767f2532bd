"""File identity of recordings, from ``binaryFile`` scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE = 1 << 20
FORMATS = ("mp4", "mkv")


def sampled_hash(content: Column, size: Column, edge: int = EDGE) -> Column:
    """sha256 of the first edge bytes, the last edge bytes that don't overlap them, and the size in decimal."""
    tail = F.least(F.lit(edge), F.greatest(F.lit(0), size - edge)).cast("int")
    last = F.when(tail > 0, F.substring(content, (size - tail + 1).cast("int"), tail)).otherwise(F.unhex(F.lit("")))
    return F.sha2(F.concat(F.substring(content, 1, edge), last, size.cast("string").cast("binary")), 256)


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, format, file_hash, content_hash, match_id and status of every file; what can't be used has its reason as status.

    Spark's scan leaves out files without content.
    """
    files = spark.read.format("binaryFile").load(path)
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    status = F.when(~kind.isin(*FORMATS), "UNSUPPORTED_FORMAT").otherwise("OK")
    digest = sampled_hash(F.col("content"), F.col("length"))
    return files.select("path", F.col("length").alias("size"), kind.alias("format"), digest.alias("file_hash"), F.sha2("content", 256).alias("content_hash"), F.substring(digest, 1, 12).alias("match_id"), status.alias("status"))
