"""Queries over the worker registry and heartbeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.operators import workers as wk
from shardloom.operators.ring import eviction_moves as eviction
from shardloom.plans.placement import ranked, ring_of, shards_of
from shardloom.plans.registry import query
from shardloom.plans.sql_views import FNV, K, with_views
from shardloom.session import small
from shardloom.sources import views
from shardloom.sources.tables import table

AS_OF_SQL = f"TIMESTAMP '{views.AS_OF}'"
SILENT_SQL = f"(epoch_us({AS_OF_SQL}) - epoch_us(ts)) / 1000000"
TIMEOUT_S = 3600
REGISTER_SQL = (
    "requests_in AS (SELECT event_id, user_id AS worker_id, ts FROM events WHERE event_type = 'signup'), "
    "firsts AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM (SELECT *, row_number() OVER "
    "(PARTITION BY worker_id ORDER BY ts, event_id) AS n FROM requests_in) WHERE n = 1), "
    "last_in AS (SELECT ts AS full_ts, event_id AS full_id FROM firsts WHERE place = 99)"
)


def latest(spark, sf):
    return wk.latest_heartbeat(views.heartbeats(spark, sf))


@query(
    "register_workers",
    with_views(
        extra=REGISTER_SQL,
        query="SELECT r.event_id, 'node-' || r.worker_id AS worker_id, r.ts, coalesce(f.event_id = r.event_id AND f.place < 100, FALSE) AS accepted, "
        "CASE WHEN f.event_id = r.event_id AND f.place < 100 THEN NULL WHEN (r.ts, r.event_id) > (l.full_ts, l.full_id) THEN 'max_workers_reached' "
        "ELSE 'already_registered' END AS reason, CASE WHEN f.event_id = r.event_id AND f.place < 100 THEN f.place END AS rank "
        "FROM requests_in r JOIN firsts f ON f.worker_id = r.worker_id LEFT JOIN last_in l ON TRUE",
    ),
)
def register_workers(spark, sf):
    log = table(spark, sf, "events").filter("event_type = 'signup'")
    log = log.select("event_id", F.concat(F.lit("node-"), F.col("user_id").cast("string")).alias("worker_id"), "ts")
    return wk.register_workers(log, max_workers=100)


@query(
    "world_size_at_registration",
    with_views(
        extra="changes AS (SELECT min(ts) AS ts, min_by(event_id, ts) AS event_id, user_id, 1 AS delta FROM events GROUP BY user_id "
        "UNION ALL SELECT max(ts), max_by(event_id, ts), user_id, -1 FROM events WHERE event_type = 'error' GROUP BY user_id "
        "HAVING max_by(event_id, ts) NOT IN (SELECT min_by(event_id, ts) FROM events GROUP BY user_id))",
        query="SELECT event_id, 'node-' || user_id AS worker_id, ts, CAST(delta AS BIGINT) AS delta, "
        "CAST(sum(delta) OVER (ORDER BY ts, event_id) AS BIGINT) AS world_size FROM changes",
    ),
)
def world_size_at_registration(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    at = F.struct("ts", "event_id")
    ends = events.groupBy("user_id").agg(F.min(at).alias("joined"), F.max(F.when(F.col("event_type") == "error", at)).alias("left"))
    change = lambda c, d: F.struct(F.col(c).alias("at"), F.lit(d).cast("bigint").alias("delta"))
    changes = ends.select("user_id", F.explode(F.array(change("joined", 1), change("left", -1))).alias("c"), "joined")
    # A node whose first event is its last error joins and stays.
    changes = changes.filter("c.at is not null and (c.delta = 1 or c.at.event_id <> joined.event_id)")
    changes = changes.select(
        F.col("c.at.event_id").alias("event_id"),
        F.concat(F.lit("node-"), F.col("user_id").cast("string")).alias("worker_id"),
        F.col("c.at.ts").alias("ts"),
        F.col("c.delta").alias("delta"),
    )
    return wk.world_size_at_registration(changes)


@query(
    "compact_ranks",
    with_views(
        "workers_v", "latest_v",
        query="SELECT worker_id, registered_at, gpu_count, row_number() OVER (ORDER BY worker_id) - 1 AS rank FROM workers_v "
        "WHERE worker_id NOT IN (SELECT worker_id FROM latest_v WHERE state = 'ERROR')",
    ),
)
def compact_ranks(spark, sf):
    failed = latest(spark, sf).filter("state = 'ERROR'")
    return wk.compact_ranks(views.workers(spark, sf), failed)


@query(
    "latest_heartbeat",
    with_views("latest_v", query="SELECT worker_id, ts, event_id, state, cpu_percent, memory_used_bytes FROM latest_v"),
)
def latest_heartbeat(spark, sf):
    return latest(spark, sf)


@query(
    "unknown_workers",
    with_views(
        "heartbeats_v", "ranked_v",
        query="SELECT event_id, worker_id FROM heartbeats_v WHERE worker_id NOT IN (SELECT worker_id FROM ranked_v WHERE rank < 10)",
    ),
)
def unknown_workers(spark, sf):
    registered = ranked(spark, sf).filter("rank < 10")
    return wk.unknown_workers(views.heartbeats(spark, sf).select("event_id", "worker_id"), registered)


@query(
    "latest_progress",
    with_views(
        "heartbeats_v", "latest_v",
        query="SELECT l.worker_id, l.current_step, l.current_epoch, t.current_task FROM latest_v l LEFT JOIN (SELECT worker_id, "
        "arg_max(current_task, event_id) AS current_task FROM heartbeats_v WHERE current_task IS NOT NULL GROUP BY worker_id) t "
        "ON l.worker_id = t.worker_id",
    ),
)
def latest_progress(spark, sf):
    return wk.latest_progress(views.heartbeats(spark, sf))


@query(
    "decode_state",
    "SELECT event_id, code, CASE WHEN code IS NULL THEN 'IDLE' WHEN code = 2 THEN 'IDLE' WHEN code = 3 THEN 'LOADING_DATA' WHEN code = 4 THEN 'TRAINING' "
    "WHEN code = 5 THEN 'CHECKPOINTING' WHEN code = 6 THEN 'RECOVERING' WHEN code = 7 THEN 'ERROR' ELSE 'INITIALIZING' END AS state "
    f"FROM (SELECT event_id, CASE WHEN {K} % 11 < 10 THEN {K} % 11 END AS code FROM events)",
)
def decode_state(spark, sf):
    code = views.prop_k(F.col("props")) % 11
    codes = table(spark, sf, "events").select("event_id", F.when(code < 10, code).alias("code"))
    return codes.withColumn("state", wk.decode_state(F.col("code")))


@query(
    "api_status",
    with_views(
        "latest_v",
        query="SELECT worker_id, current_step, current_epoch, CASE state WHEN 'IDLE' THEN 'idle' WHEN 'TRAINING' THEN 'active' "
        "WHEN 'ERROR' THEN 'failed' ELSE 'unknown' END AS status FROM latest_v",
    ),
)
def api_status(spark, sf):
    newest = wk.latest_heartbeat(views.heartbeats(spark, sf), ("state", "current_step", "current_epoch"))
    return newest.select("worker_id", "current_step", "current_epoch", wk.api_status(F.col("state")).alias("status"))


@query(
    "active_workers",
    with_views("latest_v", query="SELECT worker_id, state, state = 'IDLE' AS can_accept_work FROM latest_v WHERE state <> 'ERROR'"),
)
def active_workers(spark, sf):
    return wk.active_workers(latest(spark, sf)).select("worker_id", "state", "can_accept_work")


@query(
    "worker_counts",
    with_views("latest_v", query="SELECT count(*) FILTER (WHERE state IN ('TRAINING', 'IDLE')) AS active_workers, count(*) AS total_workers FROM latest_v"),
)
def worker_counts(spark, sf):
    return wk.worker_counts(latest(spark, sf))


@query(
    "dead_workers",
    with_views("latest_v", query=f"SELECT worker_id, ts, state, {SILENT_SQL} AS silent_s FROM latest_v WHERE {SILENT_SQL} > {TIMEOUT_S}"),
)
def dead_workers(spark, sf):
    dead = wk.dead_workers(latest(spark, sf), views.as_of(), TIMEOUT_S)
    return dead.select("worker_id", "ts", "state", "silent_s")


@query(
    "evict_dead",
    with_views(
        "workers_v", "latest_v",
        query="SELECT w.worker_id, w.gpu_count, d.worker_id IS NOT NULL AS evicted, CASE WHEN d.worker_id IS NULL THEN "
        "row_number() OVER (PARTITION BY d.worker_id IS NULL ORDER BY w.worker_id) - 1 END AS new_rank FROM workers_v w LEFT JOIN "
        f"(SELECT worker_id FROM latest_v WHERE {SILENT_SQL} > {TIMEOUT_S}) d ON w.worker_id = d.worker_id",
    ),
)
def evict_dead(spark, sf):
    dead = small(wk.dead_workers(latest(spark, sf), views.as_of(), TIMEOUT_S).select("worker_id"))
    evicted = wk.evict_dead(small(views.workers(spark, sf)), dead)
    return evicted.select("worker_id", "gpu_count", "evicted", "new_rank")


@query(
    "eviction_moves",
    with_views(
        "ring_assign_v", "latest_v",
        extra=f"rest_ring AS (SELECT * FROM ring_v WHERE worker_id NOT IN (SELECT worker_id FROM latest_v WHERE {SILENT_SQL} > {TIMEOUT_S})), "
        "rest_assign AS (SELECT s.dataset_id, s.shard_id, coalesce(r.worker_id, (SELECT min_by(worker_id, position) FROM rest_ring)) AS worker_id FROM "
        "(SELECT *, " + FNV.format("dataset_id || ':' || shard_id") + " AS at FROM shards_v) s ASOF LEFT JOIN rest_ring r ON s.at <= r.position)",
        query="SELECT a.dataset_id, a.shard_id, a.worker_id AS from_worker, p.worker_id AS to_worker FROM ring_assign_v a "
        "JOIN rest_assign p ON a.dataset_id = p.dataset_id AND a.shard_id = p.shard_id WHERE a.worker_id <> p.worker_id",
    ),
)
def eviction_moves(spark, sf):
    dead = wk.dead_workers(latest(spark, sf), views.as_of(), TIMEOUT_S)
    return eviction(shards_of(spark, sf), ring_of(spark, sf), dead)


@query(
    "aggregate_resources",
    with_views(
        "latest_v",
        query="SELECT (SELECT count(*) FROM latest_v WHERE state <> 'ERROR') AS workers, "
        "(SELECT round(sum(cpu_percent), 6) FROM latest_v WHERE state <> 'ERROR') AS cpu_percent, "
        "(SELECT CAST(sum(memory_used_bytes) AS BIGINT) FROM latest_v WHERE state <> 'ERROR') AS memory_used_bytes, "
        "count(*) AS gpu_readings, round(sum(abs(CAST(e.embedding[g] AS DOUBLE)) * 100), 6) AS utilization FROM "
        "(SELECT 'worker-' || (vec_id % 16) AS worker_id, arg_max(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) e "
        "JOIN latest_v l ON l.worker_id = e.worker_id AND l.state <> 'ERROR', unnest(range(1, len(e.embedding) + 1)) AS u(g)",
    ),
)
def aggregate_resources(spark, sf):
    gpus = views.gpus(spark, sf).groupBy("worker_id").agg(F.max_by("gpus", "vec_id").alias("gpus"))
    totals = wk.aggregate_resources(latest(spark, sf), gpus)
    return totals.select(
        "workers",
        F.round("cpu_percent", 6).alias("cpu_percent"),
        "memory_used_bytes",
        F.size("gpus").cast("bigint").alias("gpu_readings"),
        F.round(F.aggregate("gpus", F.lit(0.0), lambda s, g: s + g["utilization_percent"]), 6).alias("utilization"),
    )


@query(
    "gpu_stats",
    "SELECT 'worker-' || (vec_id % 16) AS worker_id, g - 1 AS gpu_id, count(*) AS readings, "
    "round(avg(abs(CAST(embedding[g] AS DOUBLE)) * 100), 6) AS avg_utilization, round(max(abs(CAST(embedding[g] AS DOUBLE)) * 50 + 30), 6) AS max_temperature, "
    "round(sum(vec_id * 1024 + g - 1) / sum(vec_id * 4096 + 8), 6) AS memory_share FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS g FROM embeddings) GROUP BY 1, 2",
)
def gpu_stats(spark, sf):
    return wk.gpu_stats(views.gpus(spark, sf))


@query(
    "parse_task",
    with_views(
        "heartbeats_v",
        query="SELECT event_id, current_task, split_part(current_task, '_', 1) AS action, split_part(current_task, '_', 2) AS symbol "
        "FROM heartbeats_v",
    ),
)
def parse_task(spark, sf):
    return wk.parse_task(views.heartbeats(spark, sf)).select("event_id", "current_task", "action", "symbol")


@query(
    "task_activity",
    with_views(
        "heartbeats_v",
        query="SELECT split_part(current_task, '_', 1) AS action, split_part(current_task, '_', 2) AS symbol, count(*) AS heartbeats, "
        "arg_max(current_step, event_id) AS latest_step FROM heartbeats_v WHERE current_task IS NOT NULL GROUP BY 1, 2",
    ),
)
def task_activity(spark, sf):
    return wk.task_activity(views.heartbeats(spark, sf))


@query(
    "heartbeat_gaps",
    with_views(
        "heartbeats_v",
        query="SELECT worker_id, count(*) AS heartbeats, max(gap) AS max_gap_s, count(*) FILTER (WHERE gap > 3600) AS gaps_over_timeout FROM "
        "(SELECT worker_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY worker_id ORDER BY ts, event_id))) / 1000000 AS gap "
        "FROM heartbeats_v) GROUP BY worker_id",
    ),
)
def heartbeat_gaps(spark, sf):
    return wk.heartbeat_gaps(views.heartbeats(spark, sf), TIMEOUT_S)


@query(
    "stragglers",
    with_views(
        "heartbeats_v",
        extra="pace AS (SELECT current_epoch, worker_id, count(*) AS heartbeats, CASE WHEN count(*) > 1 THEN "
        "((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) / (count(*) - 1) END AS pace_s FROM heartbeats_v GROUP BY ALL)",
        query="SELECT p.current_epoch, p.worker_id, p.heartbeats, p.pace_s, round(m.median_s, 9) AS median_s FROM pace p "
        "JOIN (SELECT current_epoch, median(pace_s) AS median_s FROM pace GROUP BY 1) m ON p.current_epoch = m.current_epoch WHERE p.pace_s > 1.25 * m.median_s",
    ),
)
def stragglers(spark, sf):
    slow = wk.stragglers(views.heartbeats(spark, sf), factor=1.25)
    return slow.withColumn("median_s", F.round("median_s", 9))
