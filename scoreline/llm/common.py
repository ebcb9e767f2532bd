"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Vectors that a task adds up at a time.
FAN = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` or the context's checkpoint folder names it.

    Where neither is set, a temporary folder serves on one machine (tests), and a cluster is an error. What stays
    in the folder is the caller's to clear once results are written.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df once into the folder that ``spark.checkpoint.dir`` names and go on from there."""
    shared_path(df.sparkSession)
    return df.checkpoint()


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id's decimal digits, modulo parts; a null id counts as the empty string."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_words(text: str | None) -> list[bytes]:
    """UTF-8 words; bytes.split() cuts at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


class Numbering(dict):
    """Numbers keys in order of first use: numbering[key]."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def slices(batch: pa.RecordBatch, name: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batch whose texts come to about most_bytes, at least a row each; bounds a task's memory."""
    column = batch.column(batch.schema.get_field_index(name))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow over parts of bounded text size."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                out = f(part)
                if out is None:
                    continue
                yield from out.to_batches() if isinstance(out, pa.Table) else (out,)

    return df.mapInArrow(run, schema)


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again; smaller than a checkpoint for large tables."""
    path = f"{shared_path(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sum_vectors(df: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], width: int, parts: int = 16) -> np.ndarray:
    """Sum of the vectors of ``width`` numbers that of(batch) gives for the batches of df.

    Each task sums its own first; the tasks' sums are added FAN at a time, level by level, so that no task reads more
    than FAN vectors, however many tasks there were.
    """
    cut = np.linspace(0, width, parts + 1).astype(int)

    def partial(batches):
        from pyspark import TaskContext

        total = np.zeros(width)
        for batch in batches:
            total += of(batch)
        if total.any():
            lanes = np.full(parts, TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts)), pa.array(lanes), pa.array([total[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], names=["part", "lane", "sums"])

    sums = tree_sum(df.mapInArrow(partial, "part long, lane long, sums binary"), df.rdd.getNumPartitions(), np.float64).toPandas()
    out = np.zeros(width)
    for part, data in zip(sums["part"], sums["sums"], strict=True):
        out[cut[part] : cut[part + 1]] = np.frombuffer(data)
    return out


def tree_sum(df: DataFrame, lanes: int, kind: type, fan: int = FAN) -> DataFrame:
    """part and sums, the sum over all lanes of the vectors that rows (part, lane below ``lanes``, sums) hold as bytes; groups hold up to ``fan`` rows."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(frame["sums"].iloc[0], kind).copy()
        for data in frame["sums"].iloc[1:]:
            total += np.frombuffer(data, kind)
        return frame.iloc[:1].assign(sums=[total.tobytes()])

    while True:
        lanes = -(-lanes // fan)
        df = df.withColumn("lane", F.col("lane") % max(1, lanes))
        df = df.groupBy("part", "lane").applyInPandas(add, "part long, lane long, sums binary")
        if lanes <= 1:
            return df.select("part", "sums")
