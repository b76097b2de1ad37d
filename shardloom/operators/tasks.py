"""Tasks, logs and the overview of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.functions.display import minutes_seconds

# Seconds between task log lines, default sizes of the listings.
LOG_STEP_S = 5
RECENT_LOGS = 100
TRAILING_POINTS = 30


def millis_between(earlier: Column, later: Column) -> Column:
    return F.unix_millis(later.cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))


def task_workers(tasks: DataFrame) -> DataFrame:
    """A new task runs on worker-0 .. worker-(n-1) and starts at progress 0."""
    numbers = F.sequence(F.lit(0).cast("bigint"), F.col("worker_count") - 1)
    spread = tasks.filter("worker_count > 0").select("task_id", "started_at", F.explode(numbers).alias("n"))
    return spread.select(
        "task_id",
        F.concat(F.lit("worker-"), F.col("n").cast("string")).alias("worker_id"),
        "started_at",
        F.lit("running").alias("status"),
        F.lit(0).cast("bigint").alias("progress"),
    )


def task_status(tasks: DataFrame, stops: DataFrame) -> DataFrame:
    """The last stop of a task completes it; stops of unknown tasks change nothing."""
    last = stops.groupBy("task_id").agg(F.max("stopped_at").alias("completed_at"))
    joined = tasks.join(last, "task_id", "left")
    status = F.when(F.col("completed_at").isNotNull(), "completed").otherwise(F.col("status"))
    return joined.withColumn("status", status)


def merge_tasks(own: DataFrame, others: DataFrame) -> DataFrame:
    """Own tasks, and the others whose id is not among them."""
    return own.unionByName(others.join(own.select("task_id"), "task_id", "left_anti"))


def task_logs(lines: DataFrame, as_of: Column) -> DataFrame:
    """Number the lines of (task_id, lines ARRAY) and date them back from ``as_of``."""
    each = lines.select("task_id", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "message"))
    back = (F.col("n") - F.col("i")) * LOG_STEP_S
    return each.select(
        F.concat_ws("_", F.lit("log"), "task_id", F.col("i").cast("string")).alias("log_id"),
        "task_id",
        (as_of - F.make_dt_interval(secs=back.cast("decimal(18,6)"))).alias("time"),
        F.lit("info").alias("level"),
        F.lit("task_manager").alias("source"),
        "message",
    )


def recent_logs(logs: DataFrame, limit: int = RECENT_LOGS) -> DataFrame:
    return logs.orderBy(F.desc("time"), F.desc("log_id")).limit(limit)


def search_logs(logs: DataFrame, term: str = "", level: str = "all", source: str = "all") -> DataFrame:
    """Case-blind search in message or source, with exact level and source."""
    found = logs
    if term:
        wanted = F.lit(term.lower())
        found = found.filter(
            F.contains(F.lower("message"), wanted) | F.contains(F.lower(F.coalesce("source", F.lit(""))), wanted)
        )
    if level != "all":
        found = found.filter(F.col("level") == level)
    if source != "all":
        found = found.filter(F.col("source") == source)
    return found


def log_sources(logs: DataFrame) -> DataFrame:
    return logs.filter("source is not null and source <> ''").select("source").distinct()


def export_lines(logs: DataFrame) -> DataFrame:
    """One text line per log entry: [time] LEVEL [source] message."""
    time = F.date_format("time", "yyyy-MM-dd HH:mm:ss")
    line = F.format_string("[%s] %s [%s] %s", time, F.upper("level"), F.col("source"), F.col("message"))
    return logs.select(line.alias("value"))


def export_logs(logs: DataFrame, path: str) -> None:
    export_lines(logs).write.mode("errorifexists").text(path)


def task_durations(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Running time per task, open tasks until ``as_of``."""
    millis = millis_between(F.col("started_at"), F.coalesce("completed_at", as_of))
    timed = tasks.withColumn("duration_ms", millis)
    return timed.withColumn("duration", minutes_seconds(F.col("duration_ms")))


def section(df: DataFrame, name: str, key: Column, value: Column) -> DataFrame:
    """Part of the overview in long form (section, key, value)."""
    return df.select(F.lit(name).alias("section"), key.cast("string").alias("key"), value.cast("string").alias("value"))


def dataset_progress(increments: DataFrame, manifest: DataFrame) -> DataFrame:
    """Samples processed per dataset, never more than it has."""
    done = increments.groupBy("dataset_id").agg(F.sum("samples").alias("done"))
    joined = manifest.select("dataset_id", "total_samples").join(done, "dataset_id", "left")
    processed = F.least(F.coalesce("done", F.lit(0)), F.col("total_samples")).cast("bigint")
    return joined.select("dataset_id", "total_samples", processed.alias("processed_samples"))


def fleet_progress(latest: DataFrame) -> DataFrame:
    """One row: workers training, whole mean step, mean loss where one is given."""
    return latest.agg(
        F.count_if(F.col("state") == "TRAINING").alias("training"),
        F.floor(F.avg("current_step")).cast("bigint").alias("mean_step"),
        F.round(F.coalesce(F.avg("loss"), F.lit(0.0)), 6).alias("mean_loss"),
    )
