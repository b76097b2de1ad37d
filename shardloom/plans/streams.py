"""Streaming queries, run over all available data and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.plans.registry import ORACLES, query
from shardloom.plans.requests import BURST, RATE, placed_sql
from shardloom.plans.sql_views import with_views
from shardloom.session import work_folder
from shardloom.sources import views
from shardloom.sources.tables import table
from shardloom.streaming import arrivals as sa
from shardloom.streaming import catalogue as sc
from shardloom.streaming import heartbeats as sh
from shardloom.streaming import requests as sr
from shardloom.streaming.run import event_time, file_stream, newest_state, run_available_now

DELAY_S = 600
TIMEOUT_S = 21_600
GAP_S = 3600
WATERMARK = f"(SELECT max(ts) - INTERVAL {DELAY_S} SECOND FROM events)"


def stream(spark, sf, name):
    return file_stream(spark, sf, table(spark, sf, name).schema, f"{name}.parquet")


def plain_times(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def beats(spark, sf):
    return event_time(views.heartbeat_columns(stream(spark, sf, "events")), "ts", f"{DELAY_S} seconds")


@query(
    "stream_latest_heartbeat",
    with_views("latest_v", query="SELECT worker_id, ts, event_id, state, cpu_percent, memory_used_bytes FROM latest_v"),
)
def stream_latest_heartbeat(spark, sf):
    updates = run_available_now(sh.stream_latest_heartbeat(beats(spark, sf)), "update", work_folder(spark, "latest"))
    return plain_times(newest_state(updates.drop("batch"), ["worker_id"], "event_id"), "ts")


@query(
    "stream_dead_workers",
    with_views(
        "heartbeats_v",
        query="SELECT worker_id, ts AS last_seen FROM (SELECT worker_id, ts, coalesce(lead(ts) OVER (PARTITION BY worker_id ORDER BY ts, event_id), "
        f"{WATERMARK}) AS next_ts FROM heartbeats_v) WHERE epoch_us(next_ts) - epoch_us(ts) > {TIMEOUT_S}::BIGINT * 1000000",
    ),
)
def stream_dead_workers(spark, sf):
    dead = run_available_now(sh.stream_dead_workers(beats(spark, sf), TIMEOUT_S), "append", work_folder(spark, "dead"))
    return plain_times(dead.drop("batch"), "last_seen")


@query(
    "stream_sessions",
    with_views(
        "heartbeats_v",
        query=f"SELECT worker_id, min(ts) AS session_start, max(ts) + INTERVAL {GAP_S} SECOND AS session_end, count(*) AS heartbeats FROM "
        "(SELECT *, sum(fresh) OVER (PARTITION BY worker_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER "
        f"(PARTITION BY worker_id ORDER BY ts, event_id)) < {GAP_S}::BIGINT * 1000000 THEN 0 ELSE 1 END AS fresh FROM heartbeats_v)) "
        f"GROUP BY worker_id, run HAVING max(ts) + INTERVAL {GAP_S} SECOND <= {WATERMARK}",
    ),
)
def stream_sessions(spark, sf):
    sessions = sh.stream_sessions(beats(spark, sf), f"{GAP_S} seconds")
    return plain_times(run_available_now(sessions, "append", work_folder(spark, "sessions")).drop("batch"), "session_start", "session_end")


@query(
    "stream_barriers",
    with_views("generations_v", query="SELECT barrier_id, worker_id, ts, event_id, generation, arrival_order, arrival_order = 16 AS releases FROM generations_v"),
)
def stream_barriers(spark, sf):
    calls = views.arrival_columns(stream(spark, sf, "events"))
    return run_available_now(sa.stream_barriers(calls, views.WORKERS), "append", work_folder(spark, "barriers")).drop("batch")


@query("stream_dedup", with_views("arrivals_v", query="SELECT DISTINCT barrier_id, worker_id FROM arrivals_v"))
def stream_dedup(spark, sf):
    calls = event_time(views.arrival_columns(stream(spark, sf, "events")), "ts", "60 days")
    return run_available_now(sa.stream_dedup(calls), "append", work_folder(spark, "dedup")).select("barrier_id", "worker_id")


@query("stream_rate_limit", f"SELECT client, event_id, allowed, tokens_left FROM ({ORACLES['rate_limit']})")
def stream_rate_limit(spark, sf):
    calls = views.request_columns(stream(spark, sf, "events"))
    return run_available_now(sr.stream_rate_limit(calls, RATE, BURST), "append", work_folder(spark, "limit")).drop("batch")


def request_windows(spark, sf, width, slide=None):
    calls = event_time(views.request_columns(stream(spark, sf, "events")), "ts", f"{DELAY_S} seconds")
    windows = sr.stream_request_windows(calls, width, slide)
    return plain_times(run_available_now(windows, "append", work_folder(spark, "windows")).drop("batch"), "window_start")


@query(
    "stream_request_windows",
    with_views(
        "requests_v",
        query="SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, method, count(*) AS requests, count(*) FILTER (WHERE is_error) AS errors, "
        f"max(latency_us) AS max_latency_us, {placed_sql(0.99)} AS p99_us FROM requests_v GROUP BY 1, 2 HAVING window_start + INTERVAL 1 MINUTE <= {WATERMARK}",
    ),
)
def stream_request_windows(spark, sf):
    return request_windows(spark, sf, "1 minute")


@query(
    "stream_sliding_windows",
    with_views(
        "requests_v",
        query="SELECT w AS window_start, method, count(*) AS requests, count(*) FILTER (WHERE is_error) AS errors, max(latency_us) AS max_latency_us, "
        f"{placed_sql(0.99)} AS p99_us FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 2 HOUR, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts)]) AS w "
        f"FROM requests_v) GROUP BY 1, 2 HAVING w + INTERVAL 3 HOUR <= {WATERMARK}",
    ),
)
def stream_sliding_windows(spark, sf):
    return request_windows(spark, sf, "3 hours", "1 hour")


@query(
    "stream_checkpoint_catalogue",
    with_views("catalogue_v", query="SELECT step, checkpoint_id, epoch, worker_id, size_bytes, notified_at, overwritten FROM catalogue_v"),
)
def stream_checkpoint_catalogue(spark, sf):
    catalogue, _ = sc.stream_checkpoint_catalogue(
        views.checkpoint_columns(stream(spark, sf, "orders")), work_folder(spark, "catalogue")
    )
    return catalogue.select("step", "checkpoint_id", "epoch", "worker_id", "size_bytes", "notified_at", "overwritten")


@query(
    "stream_kept_checkpoints",
    with_views("catalogue_v", query="SELECT step, checkpoint_id FROM catalogue_v ORDER BY step DESC LIMIT 5"),
)
def stream_kept_checkpoints(spark, sf):
    _, kept = sc.stream_checkpoint_catalogue(
        views.checkpoint_columns(stream(spark, sf, "orders")), work_folder(spark, "catalogue")
    )
    return kept.select("step", "checkpoint_id")


@query(
    "late_events",
    "WITH b AS (SELECT event_id, ts, event_id // 100 + event_id % 7 * 3 AS batch FROM events), "
    "t AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM b GROUP BY batch) "
    "SELECT b.batch, count(*) AS late_rows, min(ts) AS oldest FROM b JOIN t ON b.batch = t.batch WHERE b.ts < t.seen - INTERVAL 6 HOUR GROUP BY b.batch",
)
def late_events(spark, sf):
    # Some events arrive up to 18 batches of 100 late.
    number = F.floor(F.col("event_id") / 100) + F.col("event_id") % 7 * 3
    events = table(spark, sf, "events").select("event_id", "ts", number.cast("bigint").alias("batch"))
    late = sc.late_events(events, "batch", 6 * 3600)
    return late.groupBy("batch").agg(F.count(F.lit(1)).alias("late_rows"), F.min("ts").alias("oldest"))
