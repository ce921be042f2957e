"""Event streams: cumulative and per-interval metrics, session meters, stage checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import EDGES, STAGES, bucket

INTERVAL = "15 seconds"
#: Milliseconds after which a session without events is forgotten.
IDLE_MS = 30 * 86_400_000


def read_events(spark: SparkSession, folder: str, schema, files_per_batch: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder)


def cumulative_metrics(events: DataFrame, value: str, attributes: list[str], edges: tuple[float, ...] = EDGES) -> DataFrame:
    """Running totals by attributes: count, total and buckets since the start."""
    own = bucket(F.col(value), edges)
    return events.groupBy(*attributes).agg(F.count(value).alias("count"), F.sum(value).alias("total"), *[F.count_if(own == i).alias(f"b{i}") for i in range(len(edges) + 1)])


def interval_metrics(events: DataFrame, time: str, value: str, attributes: list[str], interval: str = INTERVAL, late: str = "1 minute") -> DataFrame:
    """What each interval adds, by event time; events later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, interval), *attributes).agg(F.count(value).alias("count"), F.sum(value).alias("total"))


def stage_stream(events: DataFrame, by: str, order: str | list[str], stage: str = "stage", late: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """Steps that no edge allows, with the stage before; the stage reached is kept for each session between batches.

    A batch's events of a session are taken in the order of ``order``, whose
    first column is their time; events later than ``late`` are dropped. A session
    that was idle for ``idle_ms`` is forgotten: its next event is a first one.
    """
    order = [order] if isinstance(order, str) else order
    events = events.withWatermark(order[0], late)
    allowed = {(a, b) for a, after in STAGES.items() for b in after}

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(frames).sort_values(order, kind="stable")
        now = rows[stage]
        before = now.shift()
        before.iloc[0] = state.get[0] if state.exists else None
        bad = before.notna() & pd.Series([step not in allowed for step in zip(before, now)], before.index)
        state.update((now.iloc[-1],))
        state.setTimeoutTimestamp(int(rows[order[0]].iloc[-1].timestamp() * 1000) + idle_ms)
        yield pd.DataFrame({by: key[0], "before": before[bad], "now": now[bad]})

    kind = events.schema[by].dataType.simpleString()
    return events.groupBy(by).applyInPandasWithState(check, f"{by} {kind}, before string, now string", "before string", "update", GroupStateTimeout.EventTimeTimeout)


def files_sink(path: str, mode: str = "append"):
    """Writes each batch as Parquet: ``append`` for rows, each batch in a folder of its own, so that a replayed one replaces itself; ``overwrite`` for running totals of which the last count."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(path if mode == "overwrite" else f"{path}/batch={batch}")

    return write


def console_sink(rows: DataFrame, batch: int) -> None:
    """Shows each batch on the driver's console."""
    rows.show(truncate=False)


def drain(stream: DataFrame, sink, mode: str, checkpoint: str) -> None:
    """Hands all that a stream has now to ``sink(rows, batch number)``, then ends."""
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(sink).start().awaitTermination()


def export(stream: DataFrame, sink, mode: str = "update", interval: str = INTERVAL, checkpoint: str | None = None):
    """Starts a query that hands each batch to ``sink(rows, batch number)``."""
    writer = stream.writeStream.outputMode(mode).trigger(processingTime=interval).foreachBatch(sink)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
