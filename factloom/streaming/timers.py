"""Timers over event streams, kept as state a key: verification due an hour after the last look, and heartbeats gone stale.

Event-time timers of transformWithState: an event sets or moves its key's timer; when the watermark passes a timer that
no later event has cancelled, the key is told of once. Keys are spread over all state partitions; a key holds two
numbers. The state store is RocksDB's, so what a task holds does not grow with its keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Due(StatefulProcessor):
    """Tells a key at span milliseconds after its last event, unless the event says that it needs none."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, due long")

    def _held(self) -> tuple[int, int] | None:
        return tuple(self.last.get()) if self.last.exists() else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        for part in rows:
            for at, rests in zip((part["at"].astype("int64") // self._unit(part)).tolist(), part["rests"].tolist(), strict=True):
                if held and at < held[0]:
                    continue  # older than what is known
                if held and held[1]:
                    self.handle.deleteTimer(held[1])
                due = 0 if rests else at + self.span
                if due:
                    self.handle.registerTimer(due)
                held = (at, due)
        if held:
            self.last.update(held)
        yield pd.DataFrame({"key": [], "since": [], "due": []}).astype({"key": str, "since": "int64", "due": "int64"})

    @staticmethod
    def _unit(part: pd.DataFrame) -> int:
        """Units of the column's times in a millisecond."""
        return {"ns": 1_000_000, "us": 1_000, "ms": 1}[part["at"].dt.unit if hasattr(part["at"].dt, "unit") else "ns"]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, held = expiredTimerInfo.getExpiryTimeInMs(), self._held()
        if held and held[1] == due:
            self.last.update((held[0], 0))
            yield pd.DataFrame({"key": [key[0]], "since": [held[0]], "due": [due]})
        else:
            yield pd.DataFrame({"key": [], "since": [], "due": []}).astype({"key": str, "since": "int64", "due": "int64"})

    def close(self) -> None:
        pass


def due(events: DataFrame, span_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """key, since and due (milliseconds) of each key that had no event for span_seconds of event time after one that does not rest.

    events: a stream of key (string), at (timestamp) and rests, whether the event asks for no timer. delay: how late
    events may come. Set ROCKS as spark.sql.streaming.stateStore.providerClass.
    """
    rows = events.select("key", "at", "rests").withWatermark("at", delay).groupBy("key")
    return rows.transformWithStateInPandas(Due(span_seconds * 1000), "key string, since long, due long", "append", "eventTime")


def stale(heartbeats: DataFrame, seconds: int = 300, delay: str = "0 seconds") -> DataFrame:
    """Workers (key) whose last heartbeat is older than seconds; a worker that retires (rests) is none."""
    return due(heartbeats, seconds, delay)


def rechecks(verifications: DataFrame, seconds: int = 3600, delay: str = "0 seconds") -> DataFrame:
    """Targets (key) to be verified again, an hour after their last verification; those without a commit to look at (rests) are left alone."""
    return due(verifications, seconds, delay)
