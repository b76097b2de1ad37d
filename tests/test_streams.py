"""Streams in several batches against the batch operators."""

import pytest
from pyspark.sql import functions as F

from shardloom.operators import barriers, checkpoints, requests, workers
from shardloom.operators.buckets import token_buckets
from shardloom.session import work_folder
from shardloom.sources import views
from shardloom.sources.tables import table
from shardloom.streaming import arrivals, catalogue, heartbeats
from shardloom.streaming import requests as stream_requests
from shardloom.streaming.run import event_time, file_stream, newest_state, run_available_now

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def parts(spark):
    """The events and orders cut into files that arrive one by one, in time order."""
    folder = work_folder(spark, "parts")
    events = table(spark, SF_DIR, "events")
    for i, (low, high) in enumerate([(0, 300), (300, 500), (500, 10**9)]):
        events.filter(f"event_id >= {low} and event_id < {high}").coalesce(1).write.mode("append").parquet(f"{folder}/events")
    orders = table(spark, SF_DIR, "orders")
    for i in range(3):
        orders.filter(f"o_orderkey % 3 = {i}").coalesce(1).write.mode("append").parquet(f"{folder}/orders")
    return folder


def stream(spark, parts, name):
    return file_stream(spark, f"{parts}/{name}", table(spark, SF_DIR, name).schema, files_per_trigger=1)


def test_latest_heartbeat(spark, parts):
    live = event_time(views.heartbeat_columns(stream(spark, parts, "events")), "ts", "10 minutes")
    out = run_available_now(heartbeats.stream_latest_heartbeat(live), "update", work_folder(spark, "t"))
    assert out.select("batch").distinct().count() == 3
    newest = newest_state(out.drop("batch"), ["worker_id"], "event_id").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert rows(newest) == rows(workers.latest_heartbeat(views.heartbeats(spark, SF_DIR)))


def test_barriers_continue_over_batches(spark, parts):
    live = views.arrival_columns(stream(spark, parts, "events"))
    out = run_available_now(arrivals.stream_barriers(live, 16), "append", work_folder(spark, "t"))
    assert out.select("batch").distinct().count() == 3
    batch = barriers.barrier_arrivals(views.arrivals(spark, SF_DIR), 16)
    columns = ["barrier_id", "worker_id", "ts", "event_id", "generation", "arrival_order"]
    assert rows(out.select(columns)) == rows(batch.select(columns))


def test_rate_limit(spark, parts):
    live = views.request_columns(stream(spark, parts, "events"))
    batch = requests.rate_limit(views.requests(spark, SF_DIR), 1 / 14400, 3).drop("retry_after_s")
    out = run_available_now(stream_requests.stream_rate_limit(live, 1 / 14400, 3), "append", work_folder(spark, "t"))
    assert out.select("batch").distinct().count() == 3
    assert rows(out.drop("batch")) == rows(batch)


def test_rate_limit_goes_on_after_a_halt_and_from_given_buckets(spark, parts):
    events = table(spark, SF_DIR, "events")
    arrived, done = work_folder(spark, "arrived"), work_folder(spark, "t")
    held = spark.range(40).select(F.col("id").alias("client"), F.lit(1).cast("bigint").alias("tokens_left"), F.lit(0).cast("bigint").alias("mark_us"))
    for low, high in ((0, 400), (400, 10**9), (0, 0)):
        events.filter(f"event_id >= {low} and event_id < {high}").coalesce(1).write.mode("append").parquet(arrived)
        live = views.request_columns(file_stream(spark, arrived, events.schema))
        out = run_available_now(stream_requests.stream_rate_limit(live, 1 / 14400, 3, buckets=held), "append", done)
    calls = views.requests(spark, SF_DIR)
    want = token_buckets(calls, 1 / 14400, 3, held).select("client", "event_id", "allowed", "tokens_left")
    assert rows(out.drop("batch")) == rows(want)


def test_silences(spark, parts):
    live = event_time(views.heartbeat_columns(stream(spark, parts, "events")), "ts", "1 minute")
    out = run_available_now(heartbeats.stream_dead_workers(live, 6 * 3600), "append", work_folder(spark, "t"))
    gaps = workers.heartbeat_gaps(views.heartbeats(spark, SF_DIR), 6 * 3600)
    between = gaps.agg(F.sum("gaps_over_timeout")).first()[0]
    beats = views.heartbeats(spark, SF_DIR)
    top = beats.agg(F.max("ts") - F.expr("interval 1 minute")).scalar()
    last = workers.dead_workers(workers.latest_heartbeat(beats), top, 6 * 3600).count()
    assert out.count() == between + last


def test_catalogue_merges_batches(spark, parts):
    live = views.checkpoint_columns(stream(spark, parts, "orders"))
    merged, kept = catalogue.stream_checkpoint_catalogue(live, work_folder(spark, "t"))
    batch = checkpoints.checkpoint_catalogue(views.checkpoints(spark, SF_DIR))
    columns = [c for c in batch.columns if c != "metadata"]
    assert rows(merged.select(columns)) == rows(batch.select(columns))
    assert rows(kept.select("step")) == rows(checkpoints.retain_checkpoints(batch).select("step"))


def test_dedup_over_batches(spark, parts):
    live = event_time(views.arrival_columns(stream(spark, parts, "events")), "ts", "60 days")
    out = run_available_now(arrivals.stream_dedup(live), "append", work_folder(spark, "t"))
    assert rows(out.select("barrier_id", "worker_id")) == rows(views.arrivals(spark, SF_DIR).select("barrier_id", "worker_id").distinct())


def test_late_rows(spark):
    events = spark.createDataFrame([(0, 100), (0, 200), (1, 150), (1, 189), (1, 190)], "batch bigint, s bigint")
    events = events.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    assert sorted(r.s for r in catalogue.late_events(events, "batch", 10).collect()) == [150, 189]


def test_request_windows_with_percentiles(spark, parts):
    live = event_time(views.request_columns(stream(spark, parts, "events")), "ts", "10 minutes")
    out = run_available_now(stream_requests.stream_request_windows(live, "1 day"), "append", work_folder(spark, "t"))
    calls = views.requests(spark, SF_DIR)
    days = calls.withColumn("window_start", F.date_trunc("day", "ts"))
    batch = requests.rank_p99(days, ["window_start", "method"], "latency_us", "event_id")
    want = {(r.window_start, r.method): r.p99 for r in batch.collect()}
    got = {(r.window_start, r.method): r.p99_us for r in out.collect()}
    assert got and set(got) <= set(want) and all(want[k] == v for k, v in got.items())


def test_merged_sketches_keep_their_places(spark):
    """Places of quantiles merged from 60 small sketches, against all values; a method without latencies."""
    n = 40_000
    values = F.when(F.col("id") % 7 < 6, F.pmod(F.xxhash64("id"), F.lit(1_000_000))).otherwise(F.pmod(F.xxhash64("id"), F.lit(500)))
    calls = spark.range(n).select(
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 90_000).alias("ts"),
        F.lit("m").alias("method"), (F.col("id") % 10 == 0).alias("is_error"), values.alias("latency_us"),
    )
    none = calls.limit(3).select("ts", F.lit("none").alias("method"), F.lit(None).cast("boolean").alias("is_error"), F.lit(None).cast("bigint").alias("latency_us"))
    small = requests.latency_sketches(calls.union(none), "1 minute", k=400)
    assert small.count() > 50
    got = {r.method: r for r in requests.merged_summary(small, ["method"], k=400).collect()}
    ordered = sorted(r.latency_us for r in calls.select("latency_us").collect())
    for value, q in ((got["m"].p50_us, 0.5), (got["m"].p99_us, 0.99)):
        low, high = (sum(v < value for v in ordered) / n, sum(v <= value for v in ordered) / n)
        assert low - 0.0206 <= q <= high + 0.0206  # twice the stated 2.3 / 400 ** 0.9021
    assert (got["m"].requests, got["m"].errors, got["m"].samples) == (n, n // 10, n)
    assert (got["none"].requests, got["none"].samples, got["none"].p99_us) == (3, 0, None)
