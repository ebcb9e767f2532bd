"""Rows of a stream in order of event time, whatever micro-batches they come in: what the timeline's folds stand on.

A key's rows wait in its state until the watermark has passed them, and are then handed on in order. Spark drops rows
that come behind the watermark, so nothing ever comes before what was handed on: the fold sees the rows that a batch
query would, in the same order, less the late ones. A key's state is what it has waiting, which the watermark's delay
bounds, and what its fold holds. Keys are dealt to BLOCKS blocks by a hash, and the rows and folds of a block are one value
of the state, which comes and goes with the block's rows: a micro-batch costs by its rows, not by its keys. Waiting rows
are kept, told from ready ones and sorted as columns. One timer a block releases the rows of keys that get no new ones.
"""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import ArrayType, BooleanType, DataType, FractionalType, LongType, NumericType, StructField, StructType

#: The state store, which keeps waiting rows out of the heap; ``fold`` chooses it for the session.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time in microseconds, as the folds see it.
US = "__us"
#: Which of a row's columns, and of its keys, are null, a bit each; frames have 0 for null numbers, so that a column stays of its type.
NULLS, NULL_KEYS = "__nulls", "__null_keys"
#: What keys are dealt to; a checkpoint is bound to their number.
BLOCK, BLOCKS = "__block", 256


class InOrder(StatefulProcessor):
    """One fold over each key's rows in order; ``held`` is a tuple of the values that ``state`` describes, None at first.

    * ``take(held, row)`` answers the next row with what is held from now on and the rows to emit.
    * ``due(last, held)`` is the event time, in microseconds, after which no row can change what the fold has yet to say,
      if there is one; ``last`` is that of the latest row. Once the watermark or the next row is beyond it,
      ``finish(held)`` answers likewise. Holding None clears the state, and a later row starts anew.
    """

    state: str

    def __init__(self, columns: StructType, order: tuple[str, ...], out: list[str], **settings: Any):
        self.columns, self.order, self.out = columns, (US, *order), Row(*out)
        self.settings = settings

    def take(self, held: tuple | None, row: Row) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def take_all(self, last: int | None, held: tuple | None, rows: list[Row]) -> tuple[tuple | None, list[tuple]]:
        """take, and finish where it is due, for the next rows of a key; folds that are never due may do it in one go."""
        found = []
        for row in rows:
            held, out = self.finished(last, held, row[-1])
            found += out
            held, out = self.take(held, row)
            found += out
            last = row[-1]
        return held, found

    def due(self, last: int, held: tuple) -> int | None:
        return None

    def finish(self, held: tuple) -> tuple[tuple | None, list[tuple]]:
        return None, []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "timer long, packed binary")
        self.held = handle.getValueState("held", f"{US} long, {self.state}")
        self.named = namedtuple("Waiting", self.columns.names, rename=True)  # US is the last column
        self.at = [self.columns.names.index(c) for c in self.order]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        rows = [tuple(r[c] for c in self.columns.names) for r in rows]
        return (self.out(*r) for r in self.release(key, rows, timerValues))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        return (self.out(*r) for r in self.release(key, [], timerValues))

    def release(self, key: tuple, rows: list[tuple], timers: TimerValues) -> Iterator[tuple]:
        passed = timers.getCurrentWatermarkInMs() * 1000
        timer, packed = self.waiting.get() if self.waiting.exists() else (None, None)
        last, *values = self.held.get() if self.held.exists() else [None]
        held = tuple(values) if last is not None else None
        waiting = [*(pickle.loads(packed) if packed else ()), *rows]
        later = [r for r in waiting if r[-1] > passed]
        ready = [r for r in waiting if r[-1] <= passed]
        ready = [self.named(*r) for r in sorted(ready, key=lambda r: [(r[i] is not None, r[i]) for i in self.at])]
        held, out = self.take_all(last, held, ready)
        yield from ((*key, *r) for r in out)
        last = ready[-1][-1] if ready else last
        held, out = self.finished(last, held, passed)
        yield from ((*key, *r) for r in out)
        due = None if held is None else self.due(last, held)
        wakes = [min(r[-1] for r in later) // 1000 + 1] if later else []
        wakes += [due // 1000 + 2] if due is not None else []
        wake = min(wakes, default=None)
        if timer is not None and timer * 1000 <= passed:
            timer = None
        if wake is not None and (timer is None or wake < timer):
            self.handle.registerTimer(wake)
            timer = wake
        if later or timer is not None:
            self.waiting.update((timer, pickle.dumps(later) if later else None))
        else:
            self.waiting.clear()
        if held is None:
            self.held.clear()
        else:
            self.held.update((last, *held))

    def finished(self, last: int | None, held: tuple | None, now: int) -> tuple[tuple | None, list[tuple]]:
        due = None if held is None else self.due(last, held)
        return self.finish(held) if due is not None and due < now else (held, [])

    def close(self) -> None:
        pass


class Block:
    """The folds of a block's keys. Its state is the rows that wait, a column each, and for each key its last row's time, what its fold holds and when that is due."""

    def __init__(self, ordered: InOrder, keys: StructType, out: StructType):
        self.ordered, self.keys, self.out, self.named = ordered, keys, out, None
        self.names = [*keys.names, NULL_KEYS, *ordered.columns.names, NULLS]

    def run(self, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = max(0, state.getCurrentWatermarkMs()) * 1000
        waiting, held = pickle.loads(state.get[0]) if state.exists else (None, {})
        parts = [p for p in ([waiting] if waiting else []) + [[f[c].to_numpy() for c in self.names] for f in frames if len(f)]]
        columns = dict(zip(self.names, (np.concatenate(c) for c in zip(*parts, strict=True)), strict=True))
        later, out = np.zeros(0, bool), []
        if columns:
            later = columns[US] > passed
            for key, rows in self.ready({c: v[~later] for c, v in columns.items()}):
                last, own, _ = held.get(key, (None, None, None))
                own, found = self.ordered.take_all(last, own, rows)
                out += [key + r for r in found]
                self.hold(held, key, rows[-1][-1], own)
        for key in [k for k, (_, _, due) in held.items() if due is not None and due < passed]:
            last, own, _ = held[key]
            own, found = self.ordered.finish(own)
            out += [key + r for r in found]
            self.hold(held, key, last, own)
        self.keep(state, {c: v[later] for c, v in columns.items()} if later.any() else None, held, passed)
        if out:
            yield self.framed(out)

    def hold(self, held: dict, key: tuple, last: int, own: tuple | None) -> None:
        if own is None:
            held.pop(key, None)
        else:
            held[key] = (last, own, self.ordered.due(last, own))

    def keep(self, state: GroupState, later: dict | None, held: dict, passed: int) -> None:
        if later is None and not held:
            state.remove()
            return
        state.update((pickle.dumps((None if later is None else list(later.values()), held), pickle.HIGHEST_PROTOCOL),))
        wakes = [] if later is None else [int(later[US].min()) // 1000 + 1]
        wakes += [due // 1000 + 2 for _, _, due in held.values() if due is not None]
        if wakes:
            state.setTimeoutTimestamp(max(min(wakes), passed // 1000 + 1))

    def ready(self, columns: dict) -> Iterator[tuple[tuple, list[Row]]]:
        """Each key with its rows in order."""
        if not len(columns[US]):
            return
        self.named = self.named or namedtuple("Waiting", self.ordered.columns.names, rename=True)
        of_keys = [*self.keys.names, NULL_KEYS]
        by = [x for c in of_keys for x in self.ranks(columns[c])]
        for c in self.ordered.order:
            by += [1 - (columns[NULLS] >> self.ordered.columns.names.index(c) & 1), *self.ranks(columns[c])]
        order = np.lexsort(by[::-1])
        columns = {c: v[order] for c, v in columns.items()}
        new = np.logical_or.reduce([columns[c][1:] != columns[c][:-1] for c in of_keys])
        starts = [0, *(np.flatnonzero(new) + 1).tolist(), len(order)]
        nulls = columns[NULLS].tolist() if columns[NULLS].any() else None
        rows = [self.named(*r) for r in zip(*(self.values(columns[f.name], f, nulls, i) for i, f in enumerate(self.ordered.columns)), strict=True)]
        keys = [columns[c][starts[:-1]].tolist() for c in of_keys]
        for start, end, *key, none in zip(starts, starts[1:], *keys, strict=False):
            yield tuple(None if none >> i & 1 else k for i, k in enumerate(key)), rows[start:end]

    def ranks(self, values: np.ndarray) -> list[np.ndarray]:
        return [pd.factorize(values, sort=True)[0] if values.dtype == object else values]

    def values(self, values: np.ndarray, field: StructField, nulls: list[int] | None, i: int) -> list:
        values = values.tolist()
        if isinstance(field.dataType, ArrayType):
            values = [x if x is None else x.tolist() if isinstance(x, np.ndarray) else list(x) for x in values]
        return values if nulls is None else [None if n >> i & 1 else x for x, n in zip(values, nulls, strict=True)]

    def framed(self, out: list[tuple]) -> pd.DataFrame:
        """Rows as a frame with NULLS: nulls of numbers are 0 or NaN there, so that a column stays of its type and NaN is told from null."""
        nulls, columns = np.zeros(len(out), np.int64), {}
        for i, (f, values) in enumerate(zip(self.out, zip(*out, strict=True), strict=True)):
            if is_number(f.dataType):
                if None in values:
                    none = np.array([x is None for x in values])
                    nulls[none] |= 1 << i
                    values = [0 if x is None else x for x in values]
                columns[f.name] = np.array(values, to_arrow_type(f.dataType).to_pandas_dtype())
            else:
                columns[f.name] = pd.Series(values, dtype=object)
        return pd.DataFrame(columns | {NULLS: nulls})


def fold(stream: DataFrame, processor: type[InOrder], columns: list[str], order: tuple[str, ...], out: str, delay: str, keys: tuple[str, ...] = ("match_id",), **settings: Any) -> DataFrame:
    """The processor's fold over each key's rows of a stream with event_time; ``out`` is the schema of its rows beside the keys.

    Rows that come more than ``delay`` behind the latest may be dropped. Of rows with one event time, order is by the
    columns given, nulls first.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.withWatermark("event_time", delay).select(*keys, "event_time", *columns, F.unix_micros("event_time").alias(US))
    held = StructType([f for f in rows.schema if f.name not in (*keys, "event_time")])
    of_keys = StructType([rows.schema[k] for k in keys])
    out = StructType([*of_keys, *StructType.fromDDL(out)])
    block = F.pmod(F.xxhash64(*keys), F.lit(BLOCKS)).cast("int").alias(BLOCK)
    rows = rows.select(block, *without_nulls(of_keys, NULL_KEYS), "event_time", *without_nulls(held, NULLS))
    of_block = Block(processor(held, order, out.names, **settings), of_keys, out)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return of_block.run(frames, state)

    framed = StructType([*out, StructField(NULLS, LongType())])
    found = rows.groupBy(BLOCK).applyInPandasWithState(run, framed, "packed binary", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(*(with_nulls(f, i).alias(f.name) for i, f in enumerate(out)))


def without_nulls(fields: StructType, name: str) -> list[Column]:
    """The fields, 0 for null numbers, and the column ``name`` with a bit for each null."""
    zero = [F.coalesce(f.name, F.lit(0).cast(f.dataType)).alias(f.name) if is_number(f.dataType) else F.col(f.name) for f in fields]
    return [*zero, sum((F.when(F.col(f.name).isNull(), 1 << i).otherwise(0) for i, f in enumerate(fields)), F.lit(0)).alias(name)]


def with_nulls(field: StructField, i: int) -> Column:
    """The field of a frame that Block made, whose place among the columns is i: NaN has come as null, and NULLS tells which values are null."""
    if not is_number(field.dataType):
        return F.col(field.name)
    value = F.coalesce(field.name, F.lit(float("nan")).cast(field.dataType)) if isinstance(field.dataType, FractionalType) else F.col(field.name)
    return F.when(F.col(NULLS).bitwiseAND(1 << i) == 0, value)


def is_number(kind: DataType) -> bool:
    return isinstance(kind, NumericType | BooleanType)
