"""Commentaries and frame plans as Spark data sources, registered by name.

    register(spark)
    spark.read.format("ball_commentary").load(folder)                    match_id, innings, ball, description, delivery_id
    spark.read.format("frame_plan").option("rate", 3).load(manifest)      match_id, frame_index, timestamp_seconds

ball_commentary has a partition for each file ``<match_id>.json``; frame_plan one for each ``frames`` (FRAMES) frames of a recording, listed in a Parquet
manifest (match_id, frame_count, fps), a row a recording. Filters on match_id and frame_index are pushed down: files and ranges that
they rule out are no partitions. Both read through Python's file system, so paths are of a folder that driver and
executors share; read_commentary reads what only Spark can.

Another provider is a subclass of DataSource whose schema is COMMENTARY, given to ``register`` with the rest.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

COMMENTARY = "match_id long, innings int, ball string, description string, delivery_id long"
PLAN = "match_id long, frame_index long, timestamp_seconds double"
FRAMES = 1 << 18


class CommentaryError(ValueError):
    """A commentary that is missing, or is not of the form it should have."""


def register(spark: SparkSession, *others: type[DataSource]) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (CommentarySource, FramePlanSource, *others):
        spark.dataSource.register(source)


class Bounds:
    """What filters leave of a whole-number column: a range, and perhaps some values."""

    def __init__(self):
        self.low, self.high, self.values = -(1 << 63), (1 << 63) - 1, None

    def take(self, f: Filter) -> bool:
        """Narrow the bounds; whether the filter is met by what they leave, so that Spark need not test it."""
        if isinstance(f, EqualTo) and f.value is not None:
            self.only({f.value})
        elif isinstance(f, In):
            self.only({v for v in f.value if v is not None})
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = min(self.high, f.value - isinstance(f, LessThan))
        else:
            return False
        return True

    def only(self, values: set) -> None:
        self.values = values if self.values is None else self.values & values

    def hold(self, value: int) -> bool:
        return self.low <= value <= self.high and (self.values is None or value in self.values)

    def any_in(self, first: int, last: int) -> bool:
        return max(first, self.low) <= min(last, self.high) and (self.values is None or any(first <= v <= last and self.hold(v) for v in self.values))


class BoundedReader(DataSourceReader):
    columns: tuple[str, ...] = ("match_id",)

    def __init__(self, options: dict):
        self.options, self.bounds = options, {c: Bounds() for c in self.columns}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            attribute = getattr(f, "attribute", ())
            if len(attribute) != 1 or attribute[0] not in self.bounds or not self.bounds[attribute[0]].take(f):
                yield f

    def path(self) -> str:
        path = self.options.get("path", "").removeprefix("file:")
        if not os.path.exists(path):
            raise CommentaryError(f"nothing is there to read: {path}")
        return path


# -- commentary


@dataclass
class File(InputPartition):
    path: str
    match_id: int


def delivery_rows(path: str, match_id: int) -> list[tuple]:
    """All deliveries of a file, or an error that names it; never a part of them."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        rows = []
        for part in found["innings"]:
            number = part["innings"]
            if isinstance(number, bool) or not isinstance(number, int):
                raise TypeError(f"innings {number!r}")
            for at, delivery in enumerate(part["commentary"]):
                values = delivery["ball"], delivery["description"]
                if not all(isinstance(v, str) for v in values):
                    raise TypeError(f"delivery {at} of innings {number}")
                rows.append((match_id, number, *values, number * 1_000_000 + at))
        return rows
    except (OSError, ValueError, KeyError, TypeError) as fault:
        raise CommentaryError(f"{path}: {type(fault).__name__}: {fault}") from fault


class CommentaryReader(BoundedReader):
    def partitions(self) -> list[File]:
        path, found = self.path(), []
        for name in sorted(os.listdir(path)) if os.path.isdir(path) else [os.path.basename(path)]:
            number = re.fullmatch(r"(\d+)\.json", name)
            if number and self.bounds["match_id"].hold(int(number[1])):
                found.append(File(os.path.join(path, name) if os.path.isdir(path) else path, int(number[1])))
        return found or [File("", 0)]

    def read(self, partition: File) -> Iterator[tuple]:
        return iter(delivery_rows(partition.path, partition.match_id) if partition.path else [])


class CommentarySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ball_commentary"

    def schema(self) -> str:
        return COMMENTARY

    def reader(self, schema) -> CommentaryReader:
        return CommentaryReader(self.options)


# -- frame plans


@dataclass
class Range(InputPartition):
    """Steps first to before last of a recording: frames themselves, or multiples of a rate."""

    match_id: int
    frame_count: int
    fps: float
    first: int
    last: int


def frame_of(steps: np.ndarray, fps: float, rate: float | None) -> np.ndarray:
    return steps if rate is None else np.rint(steps / rate * fps).astype(np.int64)


class FramePlanReader(BoundedReader):
    columns = ("match_id", "frame_index")

    def rate(self) -> float | None:
        return float(self.options["rate"]) if "rate" in self.options else None

    def partitions(self) -> list[Range]:
        rate, found, size = self.rate(), [], int(self.options.get("frames", FRAMES))
        videos = pq.read_table(self.path(), columns=["match_id", "frame_count", "fps"])
        for match_id, frame_count, fps in zip(*(c.to_pylist() for c in videos.columns), strict=True):
            if not frame_count or frame_count < 0 or (rate is not None and not (rate > 0 and fps and fps > 0)) or not self.bounds["match_id"].hold(match_id):
                continue
            steps = frame_count if rate is None else int(np.ceil(frame_count / fps * rate))
            for first in range(0, steps, size):
                last = min(first + size, steps)
                ends = frame_of(np.array([first, last - 1]), fps or 0.0, rate)
                if self.bounds["frame_index"].any_in(int(ends[0]), int(ends[1])):
                    found.append(Range(match_id, frame_count, fps or 0.0, first, last))
        return found or [Range(0, 0, 0.0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rate, bounds = self.rate(), self.bounds["frame_index"]
        frames = frame_of(np.arange(partition.first, partition.last), partition.fps, rate)
        if rate is not None:
            # a step may round to the frame of the one before, also of the one before this range
            before = frame_of(np.array([partition.first - 1]), partition.fps, rate) if partition.first else np.array([-1])
            frames = frames[(np.diff(frames, prepend=before) > 0) & (frames < partition.frame_count)]
        frames = frames[(frames >= bounds.low) & (frames <= bounds.high)]
        if bounds.values is not None:
            frames = frames[np.isin(frames, list(bounds.values))]
        seconds = pa.array(frames / partition.fps) if partition.fps else pa.nulls(len(frames), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(frames), partition.match_id)), pa.array(frames), seconds], names=["match_id", "frame_index", "timestamp_seconds"])


class FramePlanSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_plan"

    def schema(self) -> str:
        return PLAN

    def reader(self, schema) -> FramePlanReader:
        return FramePlanReader(self.options)


def extract(spark: SparkSession, path: str, provider: str | Callable = "ball_commentary"):
    """The commentary at a path by a provider: the name of a registered source, or a function of (spark, path)."""
    return spark.read.format(provider).load(path) if isinstance(provider, str) else provider(spark, path)
