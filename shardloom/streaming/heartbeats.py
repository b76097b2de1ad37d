"""Heartbeat streams: newest state, silent workers, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shardloom.streaming.run import prepare

CHECK_INTERVAL_S = 5  # fixed value: seconds between liveness checks
DEAD_SCHEMA = "worker_id string, last_seen timestamp"


def stream_latest_heartbeat(heartbeats: DataFrame) -> DataFrame:
    """Newest state and resources per worker (update mode).

    Steps, epochs and tasks are not part of the streamed heartbeat. The state
    holds one row per worker, which the registry caps; combining happens before
    the shuffle.
    """
    newest = F.max_by(F.struct("ts", "event_id", "state", "cpu_percent", "memory_used_bytes"), F.struct("ts", "event_id"))
    return heartbeats.groupBy("worker_id").agg(newest.alias("h")).select("worker_id", "h.*")


def stream_sessions(heartbeats: DataFrame, gap: str = "30 seconds") -> DataFrame:
    """Runs of heartbeats whose distance stays below the gap, as they close."""
    session = F.session_window("ts", gap)
    runs = heartbeats.groupBy("worker_id", session.alias("s")).agg(F.count(F.lit(1)).alias("heartbeats"))
    return runs.select(
        "worker_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "heartbeats"
    )


class Silence(StatefulProcessor):
    """Reports each time one worker stays silent for more than the timeout.

    State is the last heartbeat; a timer waits for the watermark to pass it.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros bigint")

    def _deadline(self, last: int) -> int:
        return last // 1000 + self.timeout_ms + 1

    def _report(self, key, found: list[int]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame({"worker_id": key[0], "last_seen": pd.to_datetime(found, unit="us")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # One row per worker and check interval arrives here, see below.
        spans = pd.concat(rows)[["first_us", "last_us"]].sort_values("first_us")
        last = self.last.get()[0] if self.last.exists() else None
        found = []
        for first, end in zip(spans["first_us"].tolist(), spans["last_us"].tolist()):
            if last is not None and first - last > self.timeout_ms * 1000:
                found.append(last)
            last = end if last is None else max(last, end)
        self.handle.registerTimer(self._deadline(last))
        self.last.update((last,))
        yield from self._report(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Timers of earlier batches still fire; only the newest one counts.
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None and expiredTimerInfo.getExpiryTimeInMs() == self._deadline(last):
            self.last.clear()
            yield from self._report(key, [last])

    def close(self) -> None:
        pass


def stream_dead_workers(heartbeats: DataFrame, timeout_s: int = 30, check_s: int = CHECK_INTERVAL_S) -> DataFrame:
    """Every silence over the timeout, by its last heartbeat (append mode).

    Heartbeats shrink to one row per worker and check interval before they reach
    the stateful step, so the load of a worker there does not grow with its rate.
    """
    if check_s >= timeout_s:
        raise ValueError("the check interval must be shorter than the timeout")
    prepare(heartbeats.sparkSession)
    spans = heartbeats.groupBy(F.window("ts", f"{check_s} seconds").alias("w"), "worker_id").agg(
        F.min(F.unix_micros("ts")).alias("first_us"), F.max(F.unix_micros("ts")).alias("last_us")
    )
    spans = spans.select("worker_id", "first_us", "last_us", F.window_time("w").alias("at"))
    return spans.groupBy("worker_id").transformWithStateInPandas(
        statefulProcessor=Silence(timeout_s * 1000),
        outputStructType=DEAD_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )
