"""Queries over tasks, logs, overview and progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.functions.display import format_duration, relative_time
from shardloom.operators import barriers as br
from shardloom.operators import checkpoints as ck
from shardloom.operators import tasks as tk
from shardloom.operators import workers as wk
from shardloom.operators.requests import newest_per_group
from shardloom.plans.registry import query
from shardloom.plans.sql_views import K, with_views
from shardloom.plans.workers import AS_OF_SQL
from shardloom.session import work_folder
from shardloom.sources import views
from shardloom.sources.tables import table

STATUS_SQL = (
    "stops AS (SELECT 'task_' || (event_id % (SELECT count(*) FROM orders)) AS task_id, max(ts) AS completed_at FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1), "
    "states AS (SELECT t.task_id, t.name, t.started_at, t.worker_count, CASE WHEN s.task_id IS NOT NULL THEN 'completed' ELSE t.status END AS status, s.completed_at "
    "FROM tasks_v t LEFT JOIN stops s ON t.task_id = s.task_id)"
)


def stops(spark, sf):
    orders = table(spark, sf, "orders").agg(F.count(F.lit(1))).scalar()
    events = table(spark, sf, "events").filter(F.col("event_type").isin("error", "purchase"))
    number = F.col("event_id") % orders
    return events.select(F.concat(F.lit("task_"), number.cast("string")).alias("task_id"), F.col("ts").alias("stopped_at"))


def states(spark, sf):
    return tk.task_status(views.tasks(spark, sf), stops(spark, sf))


@query(
    "task_workers",
    with_views(
        "tasks_v",
        query="SELECT task_id, 'worker-' || i AS worker_id, started_at, 'running' AS status, 0::BIGINT AS progress FROM (SELECT *, unnest(range(worker_count)) AS i FROM tasks_v)",
    ),
)
def task_workers(spark, sf):
    return tk.task_workers(views.tasks(spark, sf))


@query("task_status", with_views("tasks_v", extra=STATUS_SQL, query="SELECT task_id, name, started_at, worker_count, status, completed_at FROM states"))
def task_status(spark, sf):
    return states(spark, sf)


@query(
    "merge_tasks",
    "SELECT 'task_' || o_orderkey AS task_id, CASE WHEN o_orderstatus IS DISTINCT FROM 'O' THEN 'own' ELSE 'other' END AS origin FROM orders",
)
def merge_tasks(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    named = lambda df, origin: df.select(
        F.concat(F.lit("task_"), F.col("o_orderkey").cast("string")).alias("task_id"), F.lit(origin).alias("origin")
    )
    # Each order is on one list at least, those in progress on both.
    own, others = orders.filter("not (o_orderstatus <=> 'O')"), orders.filter("not (o_orderstatus <=> 'F')")
    return tk.merge_tasks(named(own, "own"), named(others, "other"))


@query(
    "task_logs",
    "SELECT 'log_' || doc_id || '_' || (i - 1) AS log_id, CAST(doc_id AS VARCHAR) AS task_id, "
    f"{AS_OF_SQL} - to_seconds((len(lines) - (i - 1)) * 5) AS time, 'info' AS level, 'task_manager' AS source, lines[i] AS message "
    "FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))",
)
def task_logs(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("task_id"), F.split("text", "\n", -1).alias("lines")
    )
    return tk.task_logs(docs, views.as_of())


@query("recent_logs", with_views("logs_v", query="SELECT log_id, time, level, source, message FROM logs_v ORDER BY time DESC, log_id DESC LIMIT 100"))
def recent_logs(spark, sf):
    return tk.recent_logs(views.logs(spark, sf))


@query(
    "search_logs",
    "SELECT doc_id, source FROM documents WHERE (contains(lower(text), 'the and') OR contains(lower(source), 'the and')) AND lang = 'en'",
)
def search_logs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("message"), "source", F.col("lang").alias("level"))
    return tk.search_logs(docs, "The And", level="en").select("doc_id", "source")


@query("log_sources", "SELECT DISTINCT source FROM documents WHERE source <> ''")
def log_sources(spark, sf):
    return tk.log_sources(table(spark, sf, "documents"))


@query(
    "export_logs",
    with_views("logs_v", query="SELECT '[' || strftime(time, '%Y-%m-%d %H:%M:%S') || '] ' || upper(level) || ' [' || source || '] ' || message AS line FROM logs_v"),
)
def export_logs(spark, sf):
    path = work_folder(spark, "logs")
    tk.export_logs(views.logs(spark, sf), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(
    "task_durations",
    with_views(
        "tasks_v", extra=STATUS_SQL,
        query="SELECT task_id, ms AS duration_ms, (ms // 60000) || 'm ' || (ms % 60000 // 1000) || 's' AS duration, CASE WHEN ms >= 3600000 THEN (ms // 3600000) || 'h ' || "
        "(ms // 60000 % 60) || 'm' WHEN ms >= 60000 THEN (ms // 60000) || 'm ' || (ms // 1000 % 60) || 's' ELSE (ms // 1000) || 's' END AS short, "
        "CASE WHEN ago < 1000 THEN 'just now' WHEN ago < 60000 THEN (ago // 1000) || 's ago' WHEN ago < 3600000 THEN (ago // 60000) || 'm ago' ELSE (ago // 3600000) || 'h ago' END AS ended "
        f"FROM (SELECT task_id, epoch_us(coalesce(completed_at, {AS_OF_SQL})) // 1000 - epoch_us(started_at) // 1000 AS ms, "
        f"epoch_us({AS_OF_SQL}) // 1000 - epoch_us(coalesce(completed_at, {AS_OF_SQL})) // 1000 AS ago FROM states)",
    ),
)
def task_durations(spark, sf):
    timed = tk.task_durations(states(spark, sf), views.as_of())
    ago = tk.millis_between(F.coalesce("completed_at", views.as_of()), views.as_of())
    return timed.select(
        "task_id", "duration_ms", "duration",
        format_duration(F.col("duration_ms")).alias("short"),
        relative_time(ago).alias("ended"),
    )


@query(
    "overview",
    with_views(
        "latest_v", "manifest_v", "catalogue_v", "generations_v", "tasks_v", "logs_v", extra=STATUS_SQL,
        query="SELECT 'workers' AS section, worker_id AS key, CASE state WHEN 'IDLE' THEN 'idle' WHEN 'TRAINING' THEN 'active' WHEN 'ERROR' THEN 'failed' ELSE 'unknown' END AS value FROM latest_v "
        "UNION ALL SELECT 'datasets', dataset_id, CAST(total_shards AS VARCHAR) FROM manifest_v "
        "UNION ALL (SELECT 'checkpoints', CAST(step AS VARCHAR), checkpoint_id FROM catalogue_v ORDER BY step LIMIT 20) "
        "UNION ALL SELECT 'barriers', barrier_id || '/' || generation, count(*) || '/16' FROM generations_v WHERE NOT released GROUP BY barrier_id, generation "
        "UNION ALL SELECT 'metrics', 'active_workers', CAST(count(*) FILTER (WHERE state IN ('TRAINING', 'IDLE')) AS VARCHAR) FROM latest_v "
        "UNION ALL SELECT 'metrics', 'total_workers', CAST(count(*) AS VARCHAR) FROM latest_v "
        "UNION ALL SELECT 'tasks', status, CAST(count(*) AS VARCHAR) FROM states GROUP BY status "
        "UNION ALL SELECT 'logs', level, CAST(count(*) AS VARCHAR) FROM logs_v GROUP BY level",
    ),
)
def overview(spark, sf):
    latest = wk.latest_heartbeat(views.heartbeats(spark, sf), ("state",))
    counts = wk.worker_counts(latest)
    listed = ck.list_checkpoints(ck.checkpoint_catalogue(views.checkpoints(spark, sf)))
    arrived = br.barrier_arrivals(views.arrivals(spark, sf), views.WORKERS).filter("not released")
    waiting = br.barrier_status(arrived, views.WORKERS)
    per_status = states(spark, sf).groupBy("status").count()
    per_level = views.logs(spark, sf).groupBy("level").count()
    c = F.col
    parts = [
        tk.section(latest, "workers", c("worker_id"), wk.api_status(c("state"))),
        tk.section(views.manifest(spark, sf), "datasets", c("dataset_id"), c("total_shards")),
        tk.section(listed, "checkpoints", c("step"), c("id")),
        tk.section(
            waiting, "barriers", F.concat_ws("/", "barrier_id", c("generation").cast("string")),
            F.concat_ws("/", c("arrived").cast("string"), c("total").cast("string")),
        ),
        tk.section(counts, "metrics", F.lit("active_workers"), c("active_workers")),
        tk.section(counts, "metrics", F.lit("total_workers"), c("total_workers")),
        tk.section(per_status, "tasks", c("status"), c("count")),
        tk.section(per_level, "logs", c("level"), c("count")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "progress_overview",
    with_views(
        "manifest_v",
        query=f"SELECT m.dataset_id, m.total_samples, CAST(least(coalesce(d.done, 0), m.total_samples) AS BIGINT) AS processed_samples FROM manifest_v m LEFT JOIN "
        f"(SELECT {views.TABLES!r}[event_id % 14 + 1] AS dataset_id, sum({K}) AS done FROM events GROUP BY 1) d ON m.dataset_id = d.dataset_id",
    ),
)
def progress_overview(spark, sf):
    names = F.array(*[F.lit(n) for n in views.TABLES])
    increments = table(spark, sf, "events").select(
        F.get(names, (F.col("event_id") % len(views.TABLES)).cast("int")).alias("dataset_id"), views.prop_k(F.col("props")).alias("samples")
    )
    return tk.dataset_progress(increments, views.manifest(spark, sf))


@query(
    "fleet_progress",
    with_views(
        "latest_v",
        query="SELECT count(*) FILTER (WHERE state = 'TRAINING') AS training, CAST(floor(avg(current_step)) AS BIGINT) AS mean_step, "
        "round(coalesce(avg(CASE WHEN state <> 'IDLE' THEN cpu_percent END), 0), 6) AS mean_loss FROM latest_v",
    ),
)
def fleet_progress(spark, sf):
    # The load stands in for a loss that idle workers do not report.
    latest = wk.latest_heartbeat(views.heartbeats(spark, sf), ("state", "current_step", "cpu_percent"))
    loss = F.when(F.col("state") != "IDLE", F.col("cpu_percent"))
    return tk.fleet_progress(latest.withColumn("loss", loss))


@query(
    "trailing_points",
    with_views(
        "requests_v",
        query="SELECT method, newest, ts, latency_us FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY ts DESC, event_id DESC) AS newest FROM requests_v) WHERE newest <= 30",
    ),
)
def trailing_points(spark, sf):
    points = views.requests(spark, sf).select("method", "ts", "event_id", "latency_us")
    return newest_per_group(points, ["method"], ["ts", "event_id"], tk.TRAILING_POINTS).drop("event_id")
