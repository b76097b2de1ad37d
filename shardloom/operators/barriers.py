"""Barrier arrivals, generations, waits and timeouts from an arrival log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.operators.ordered import ordered
from shardloom.operators.requests import rank_p99
from shardloom.operators.workers import seconds_between

BARRIER_TIMEOUT_S = 300  # fixed value: longest wait at a barrier


def barrier_arrivals(arrivals: DataFrame, expected: int, slices: int | None = None) -> DataFrame:
    """Arrival order and generation of every call at (barrier_id, worker_id, ts, event_id).

    Repeats by one worker count too. Each ``expected`` calls release a
    generation and the next call opens a new one; ``expected`` is fixed per run.
    """
    placed = ordered(
        arrivals, ["barrier_id"], ["ts", "event_id"], position="place", total="calls", slices=slices
    )
    generation = F.floor(F.col("place") / expected).cast("bigint")
    released = (generation + 1) * expected <= F.col("calls")
    return placed.select(
        "barrier_id",
        "worker_id",
        "ts",
        "event_id",
        generation.alias("generation"),
        (F.col("place") % expected + 1).alias("arrival_order"),
        released.alias("released"),
        F.when(released, F.lit(expected).cast("bigint")).alias("participants"),
    )


def barrier_arrivals_dedup(arrivals: DataFrame, expected: int) -> DataFrame:
    """One generation in which only the first call of each worker counts."""
    first = arrivals.groupBy("barrier_id", "worker_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    calls = first.select("barrier_id", "worker_id", "first.*")
    placed = ordered(calls, ["barrier_id"], ["ts", "event_id"], position="place", total="calls")
    return placed.select(
        "barrier_id",
        "worker_id",
        "ts",
        "event_id",
        (F.col("place") + 1).alias("arrival_order"),
        (F.col("calls") >= expected).alias("complete"),
    )


def barrier_status(arrived: DataFrame, expected: int) -> DataFrame:
    """Arrived, total, status and percent of every generation."""
    counts = arrived.groupBy("barrier_id", "generation").agg(F.count(F.lit(1)).alias("arrived"))
    return counts.select(
        "barrier_id",
        "generation",
        "arrived",
        F.lit(expected).cast("bigint").alias("total"),
        F.when(F.col("arrived") >= expected, "complete").otherwise("waiting").alias("status"),
        F.round(F.col("arrived") * 100 / expected, 4).alias("percent"),
    )


def barrier_wait(arrived: DataFrame) -> DataFrame:
    """Seconds each released call waited; a generation has ``expected`` rows only."""
    together = Window.partitionBy("barrier_id", "generation")
    release = F.when(F.col("released"), F.max("ts").over(together))
    waited = arrived.withColumn("released_at", release)
    return waited.withColumn("wait_s", seconds_between(F.col("ts"), F.col("released_at")))


def barrier_wait_p99(waits: DataFrame) -> DataFrame:
    done = waits.filter("released").select("barrier_id", "event_id", "wait_s")
    return rank_p99(done, ["barrier_id"], "wait_s", "event_id").withColumnRenamed("p99", "p99_wait_s")


def barrier_timeouts(waits: DataFrame, as_of: Column, limit_s: float = BARRIER_TIMEOUT_S) -> DataFrame:
    """Calls that waited beyond the limit; open generations wait until ``as_of``."""
    end = F.coalesce("released_at", as_of)
    waited = waits.withColumn("wait_s", seconds_between(F.col("ts"), end))
    return waited.filter(F.col("wait_s") > limit_s)
