"""Sessions of a stream with state of their own: meters and summaries that wait for late rows.

Rows of a key are held until the watermark has passed them, and are then taken
in the order of their times: a row that comes late, but not later than ``late``,
changes nothing that was handed on. State is kept by key in the state store, so
it survives a restart and lost executors; a key that is idle is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """Hands each key's rows (at: milliseconds, nth, value) to ``step`` in the order of time and nth, once the watermark has passed them."""

    state_schema = ""

    def __init__(self, by: str, idle: int):
        self.by, self.idle = by, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, nth long, micros long, value double")
        self.held = handle.getValueState("held", self.state_schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [r for frame in rows for r in zip(frame["at"].tolist(), frame["nth"].tolist(), frame["micros"].tolist(), frame["value"].tolist())]
        self.waiting.appendList([tuple(r) for r in new])
        self.handle.registerTimer(min(r[0] for r in new) + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready, rest = [r for r in rows if r[0] < passed], [r for r in rows if r[0] >= passed]
        if len(ready):
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(rest[0][0] + 1)
            else:
                self.waiting.clear()
        held = tuple(self.held.get()) if self.held.exists() else None
        out, held = self.step(key, sorted(ready, key=lambda r: (r[2], r[1])), held, passed)
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
            self.handle.registerTimer(self.until(held))
        if out:
            yield pd.DataFrame(out)

    def until(self, held: tuple) -> int:
        """When a key's state is looked at again if nothing comes."""
        return held[0] + self.idle + 1

    def close(self) -> None:
        pass


class _Meter(_InOrder):
    """State: the last time, the sum so far."""

    state_schema = "last long, total double"

    def step(self, key, ready, held, passed):
        last, total = held or (0, 0.0)
        out: dict[str, list] = {self.by: [], "nth": [], "running": []}
        for at, nth, _, value in ready:
            last, total = max(last, at), total + (value if value == value else 0.0)
            out[self.by].append(key[0])
            out["nth"].append(nth)
            out["running"].append(total)
        gone = passed > last + self.idle
        return (out if ready else None), None if gone else (last, total)


class _Summary(_InOrder):
    """State: the last time, and of the session under way the first and last microsecond and the number of rows."""

    state_schema = "last long, first_micros long, last_micros long, n long"

    def step(self, key, ready, held, passed):
        out: dict[str, list] = {self.by: [], "n": [], "first_micros": [], "last_micros": []}

        def emit(held):
            for name, value in zip(out, (key[0], held[3], held[1], held[2])):
                out[name].append(value)

        for at, _, micros, _ in ready:
            if held is not None and micros - held[2] > self.idle * 1000:
                emit(held)
                held = None
            held = (at, micros, micros, 1) if held is None else (max(held[0], at), held[1], max(held[2], micros), held[3] + 1)
        if held is not None and passed > held[0] + self.idle:
            emit(held)
            held = None
        return (out if out["n"] else None), held


def _run(events: DataFrame, processor: _InOrder, schema: str, by: str, time: str, nth: str, value: str, late: str) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.withWatermark(time, late).select(by, time, F.unix_millis(time).alias("at"), F.unix_micros(time).alias("micros"), F.col(nth).cast("long").alias("nth"), F.col(value).cast("double").alias("value"))
    return rows.groupBy(by).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def running_totals(events: DataFrame, by: str, time: str, nth: str, value: str, late: str = "1 hour", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """(by, nth, running): each row's number with the sum of its key's values up to it, in the order of time and ``nth``.

    A null value adds nothing. A key that is idle for ``idle_ms`` begins again at 0.
    """
    kind = events.schema[by].dataType.simpleString()
    return _run(events, _Meter(by, idle_ms), f"{by} {kind}, nth long, running double", by, time, nth, value, late)


def session_summaries(events: DataFrame, by: str, time: str, nth: str, idle_ms: int, late: str = "1 hour") -> DataFrame:
    """(by, spans, first, last): a row for each session, which ends where nothing comes for longer than ``idle_ms``."""
    kind = events.schema[by].dataType.simpleString()
    found = _run(events.withColumn("_none", F.lit(None).cast("double")), _Summary(by, idle_ms), f"{by} {kind}, n long, first_micros long, last_micros long", by, time, nth, "_none", late)
    return found.select(by, F.col("n").alias("spans"), F.timestamp_micros("first_micros").alias("first"), F.timestamp_micros("last_micros").alias("last"))
