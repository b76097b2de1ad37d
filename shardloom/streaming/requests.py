"""Request streams: windowed metrics and rate limits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shardloom.operators.buckets import decide, pause_for_one
from shardloom.operators.requests import P99, SKETCH_K, sketch_quantile
from shardloom.streaming.run import prepare


def stream_request_windows(requests: DataFrame, width: str = "1 minute", slide: str | None = None, k: int = SKETCH_K) -> DataFrame:
    """Requests, errors, longest and 99th percentile latency per method and window, once closed.

    The percentile comes from a KLL sketch of size ``k`` in the window's state: exact
    up to about ``k`` requests, its place within 0.3 % of them (k = 1600) beyond.
    """
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    per = requests.groupBy(span.alias("w"), "method").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("is_error").alias("errors"),
        F.max("latency_us").alias("max_latency_us"),
        F.count("latency_us").alias("samples"),
        F.kll_sketch_agg_bigint("latency_us", F.lit(k)).alias("sketch"),
    )
    p99 = sketch_quantile(F.col("sketch"), F.col("samples"), P99).alias("p99_us")
    return per.select(F.col("w.start").alias("window_start"), "method", "requests", "errors", "max_latency_us", p99)


class Bucket(StatefulProcessor):
    """A client's token bucket, carried from batch to batch."""

    def __init__(self, rate: float, burst: int, idle_s: int | None):
        self.rate, self.burst, self.need = rate, burst, pause_for_one(rate)
        # By then an idle bucket is full, so dropping it changes no decision.
        self.keep_ms = None if idle_s is None else max(idle_s, math.ceil((burst + 1) / rate)) * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens bigint, mark bigint", self.keep_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        first = initialState.iloc[0]
        self.bucket.update((int(first["tokens_left"]), int(first["mark_us"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(rows)[["event_id", "at_us"]].sort_values(["at_us", "event_id"])
        at = calls["at_us"].to_numpy()
        tokens, mark = self.bucket.get() if self.bucket.exists() else (self.burst, int(at[0]))
        held = np.array([tokens]), np.array([mark])
        allowed, left, marks = decide(at, np.array([0]), *held, self.need, self.rate, self.burst)
        self.bucket.update((int(left[-1]), int(marks[-1])))
        client = pd.Series([key[0]] * len(at), dtype=object)
        yield pd.DataFrame({"client": client, "event_id": calls["event_id"].to_numpy(), "allowed": allowed, "tokens_left": left})

    def close(self) -> None:
        pass


def stream_rate_limit(requests: DataFrame, rate: float, burst: int, idle_s: int | None = None, buckets: DataFrame | None = None) -> DataFrame:
    """Decide each request of (client, ts, event_id) as batches come in (append mode).

    Buckets are Spark state per client. With ``idle_s`` one goes away after so
    long without requests, and not before it would be full again, by the clock of
    the cluster: for streams that keep running (the service drops
    them after 300 s), as a run over what is available would wait for its end.
    ``buckets`` (client, tokens_left, mark_us) are there from the start. The
    requests of a client in one batch meet in one task, as narrow rows decided
    by arrays; the limit of the source on a batch bounds them.
    """
    prepare(requests.sparkSession)
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us")
    kind = dict(requests.dtypes)["client"]
    return requests.select("client", F.col("event_id").cast("bigint").alias("event_id"), at).groupBy("client").transformWithStateInPandas(
        statefulProcessor=Bucket(rate, burst, idle_s),
        outputStructType=f"client {kind}, event_id bigint, allowed boolean, tokens_left bigint",
        outputMode="Append",
        timeMode="None" if idle_s is None else "ProcessingTime",
        initialState=None if buckets is None else buckets.select("client", "tokens_left", "mark_us").groupBy("client"),
    )
