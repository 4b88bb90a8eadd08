"""Keyed state over rows in event-time order, whatever order, batch or Arrow frame they come in.

`in_order` keeps rows in list state until the watermark has passed their time, then takes them in order through a step
function with the key's held values (map state). Rows that the watermark has passed are dropped by Spark before, so nothing
that comes later can belong in front of what was released. Keys are dealt over a fixed number of groups; a group has one
event-time timer, at the earliest time at which a row of it can be released or held values expire.

Rows wait as the frames they came in, and held values lie in buckets of keys: a call of the state store costs far more than
a row does, so none is made for a single row or key. Each frame is an entry of its own under its number, packed by Arrow; the
list state holds numbers and times alone, as the store reads a list again each time that something is added to it.

State is bounded: what waits is what came within the lateness; what is held are the keys that haven't expired. A task holds
the rows of one group that are released at once as Arrow columns, and some ten thousand of them as Python values, so `groups` is chosen by the rate of rows. It can't change while a checkpoint lives.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GROUPS = 64
#: Buckets in which a group's held values are read and written.
BUCKETS = 64
#: Rows that are taken through the step function, and told, at once.
ROWS = 16_384
#: Arrow's types of columns; others are told from their values.
TYPES = {"string": pa.large_string(), **dict.fromkeys(("tinyint", "smallint", "int", "bigint", "long"), pa.int64())}
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: (held values or None, row) -> (held values or None, rows of the result). A row is (key, at, *order, *more).
Step = Callable[[tuple | None, tuple], tuple[tuple | None, list[tuple]]]


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streaming queries that start inside keep their state in RocksDB, as list state and timers demand."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class Waiting(StatefulProcessor):
    """Rows of a group that wait as Arrow frames, and one event-time timer a group. names and kinds: the rows' columns; the second is their time."""

    names: list[str]
    kinds: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "frame long, low long, high long")
        self.frames = handle.getMapState("frames", "frame long", "rows binary")
        self.wakes = handle.getValueState("wakes", "at long")

    def _stored(self, frame: int, rows: pa.Table) -> tuple[int, int, int]:
        """Puts rows under a frame's number: its entry in the list of those that wait."""
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows)
        self.frames.updateValue((frame,), (sink.getvalue().to_pybytes(),))
        ends = pc.min_max(rows[self.names[1]]).as_py()
        return frame, ends["min"], ends["max"]

    def _cut(self, frame: int, rows: pa.Table) -> list[tuple[int, int, int]]:
        return [self._stored(frame + k, rows.slice(start, 4 * ROWS)) for k, start in enumerate(range(0, len(rows), 4 * ROWS))]

    def _taken(self, frame: int) -> pa.Table:
        rows = pa.ipc.open_stream(self.frames.getValue((frame,))[0]).read_all()
        self.frames.removeKey((frame,))
        return rows

    def _came(self, rows: Iterator[pd.DataFrame]) -> Iterator[pa.Table]:
        """Puts what came to what waits, and gives it frame by frame."""
        frame = 1 + max((n for n, *_ in self.waiting.get()), default=-1)
        found = []
        for f in rows:
            if len(f):
                table = pa.table({c: pa.array(f[c], type=TYPES.get(kind), from_pandas=True) for c, kind in zip(self.names, self.kinds, strict=True)})
                found.append(self._stored(frame + len(found), table))
                yield table
        if found:
            self.waiting.appendList(found)

    def _wake(self, at: int | None) -> None:
        """One timer a group, at the earliest time that matters."""
        if at is None:
            return
        if self.wakes.exists():
            known = self.wakes.get()[0]
            if known <= at:
                return
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)
        self.wakes.update((at,))


class InOrder(Waiting):
    def __init__(self, fields: str, columns: list[str], step: Step, order: int, grain: int, expires: Callable[[tuple], int] | None):
        self.columns, self.step = columns, step
        self.order, self.grain, self.expires = order, grain, expires
        self.names, self.kinds = zip(*[c.split(" ", 1) for c in fields.split(", ")], strict=True)
        self.names = list(self.names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getMapState("held", "bucket int", "pairs binary")

    def _in_order(self, rows: pa.Table) -> Iterator[tuple]:
        places = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in self.names[1 : 2 + self.order]])
        columns = [rows[c].combine_chunks() for c in self.names]
        for start in range(0, len(places), ROWS):
            some = [c.take(places.slice(start, ROWS)) for c in columns]
            yield from zip(*[c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist() for c in some], strict=True)

    def _values(self, bucket: int) -> dict[str, tuple]:
        return pickle.loads(self.held.getValue((bucket,))[0]) if self.held.containsKey((bucket,)) else {}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        lows = [pc.min(f[self.names[1]]).as_py() for f in self._came(rows)]
        self._wake(min(lows) + self.grain if lows else None)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self.wakes.clear()
        known = list(self.waiting.get())
        wait = [w for w in known if w[1] + self.grain > mark]
        out, now = [], {}
        if len(wait) < len(known):
            rows = pa.concat_tables([self._taken(w[0]) for w in known if w[1] + self.grain <= mark], promote_options="permissive")
            due = pc.less_equal(rows[self.names[1]], mark - self.grain)
            rest, ready = rows.filter(pc.invert(due)), rows.filter(due)
            del rows, due
            wait += self._cut(1 + max(w[0] for w in known), rest)
            buckets: dict[str, int] = {}
            for row in self._in_order(ready):
                own = row[0]
                if (bucket := buckets.get(own)) is None:
                    bucket = buckets[own] = zlib.crc32(own.encode()) % BUCKETS
                    if bucket not in now:
                        now[bucket] = self._values(bucket)
                values, told = self.step(now[bucket].pop(own, None), row)
                if values is not None:
                    now[bucket][own] = values
                out += told
                if len(out) >= ROWS:
                    yield pd.DataFrame(out, columns=self.columns)
                    out = []
            self.waiting.put(wait) if wait else self.waiting.clear()
        after = [low + self.grain for _, low, _ in wait]
        if self.expires:
            for (bucket,), (pairs,) in self.held.iterator():
                if bucket not in now:
                    values = pickle.loads(pairs)
                    ends = [self.expires(v) for v in values.values()]
                    if min(ends) <= mark:
                        now[bucket] = values
                    else:
                        after.append(min(ends))
            for bucket, values in now.items():
                now[bucket] = {own: v for own, v in values.items() if self.expires(v) > mark}
                after += [self.expires(v) for v in now[bucket].values()]
        for bucket, values in now.items():
            if values:
                self.held.updateValue((bucket,), (pickle.dumps(values),))
            elif self.held.containsKey((bucket,)):
                self.held.removeKey((bucket,))
        self._wake(max(min(after), mark + 1) if after else None)
        if out:
            yield pd.DataFrame(out, columns=self.columns)


def in_order(
    rows: DataFrame, key: str, at: Column, order: list[str], more: list[str], step: Step, out: str, late: str = "1 hour", grain: int = 1, expires: Callable[[tuple], int] | None = None, groups: int = GROUPS
) -> DataFrame:
    """What step gives of rows (ts: event time) key by key, in the order of at (milliseconds of ts, cut to `grain`) and the columns of order.

    expires: the millisecond from which values no longer matter, by which time a
    step must treat them as none. Rows with a null key only move the watermark on, as heartbeats of a source do.
    """
    kinds = dict(rows.dtypes)
    # One condition that names ts, else Spark filters before the watermark has seen the heartbeat.
    known = rows.withWatermark("ts", late).where(f"if({key} is null, null, ts) is not null")
    slim = known.select(F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("event_group"), F.col(key).cast("string").alias(key), at.cast("long").alias("event_ms"), *order, *more)
    fields = ", ".join([f"{key} string", "event_ms long", *[f"{c} {kinds[c]}" for c in order + more]])
    columns = [c.strip().split()[0] for c in out.split(",")]
    return slim.groupBy("event_group").transformWithStateInPandas(InOrder(fields, columns, step, len(order), grain, expires), out, "Append", "EventTime")
