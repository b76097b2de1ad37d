"""Barrier arrivals as a stream: numbering and de-duplication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shardloom.streaming.run import prepare


class Calls(StatefulProcessor):
    """Numbers the calls at one barrier; the state is how many there were."""

    def __init__(self, expected: int):
        self.expected = expected

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.calls = handle.getValueState("calls", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values(["at_us", "event_id"], ignore_index=True)
        before = self.calls.get()[0] if self.calls.exists() else 0
        place = before + np.arange(len(batch))
        self.calls.update((before + len(batch),))
        yield batch[["barrier_id", "worker_id", "at_us", "event_id"]].astype({"barrier_id": object, "worker_id": object}).assign(
            generation=place // self.expected, arrival_order=place % self.expected + 1
        )

    def close(self) -> None:
        pass


def stream_barriers(arrivals: DataFrame, expected: int) -> DataFrame:
    """Arrival order and generation of every call, numbered as batches come in (append mode).

    Calls of one batch are ordered by time; later batches continue the count, as
    a service that stamps calls on arrival does. The count is Spark state per
    barrier. The calls at a barrier in one batch meet in one task, as narrow
    rows; the limit of the source on a batch bounds them.
    """
    prepare(arrivals.sparkSession)
    kind = dict(arrivals.dtypes)["ts"]
    slim = arrivals.select("barrier_id", "worker_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "event_id")
    numbered = slim.groupBy("barrier_id").transformWithStateInPandas(
        statefulProcessor=Calls(expected),
        outputStructType="barrier_id string, worker_id string, at_us bigint, event_id bigint, generation bigint, arrival_order bigint",
        outputMode="Append",
        timeMode="None",
    )
    return numbered.select(
        "barrier_id",
        "worker_id",
        F.timestamp_micros("at_us").cast(kind).alias("ts"),
        "event_id",
        "generation",
        "arrival_order",
        (F.col("arrival_order") == expected).alias("releases"),
    )


def stream_dedup(arrivals: DataFrame) -> DataFrame:
    """First arrivals per barrier and worker; needs a watermark on the input.

    The state of a pair is dropped once the watermark has passed it.
    """
    return arrivals.dropDuplicatesWithinWatermark(["barrier_id", "worker_id"])
