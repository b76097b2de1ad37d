"""Worker registry, heartbeats, liveness and resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.operators.ordered import ordered
from shardloom.session import small

# Wire codes of the states, the active states, the states counted
# as busy or free, the status shown to users, and the registry's limits.
WIRE_STATES = {
    0: "INITIALIZING",
    1: "INITIALIZING",
    2: "IDLE",
    3: "LOADING_DATA",
    4: "TRAINING",
    5: "CHECKPOINTING",
    6: "RECOVERING",
    7: "ERROR",
}
UNKNOWN_CODE_STATE = "INITIALIZING"
MISSING_STATE = "IDLE"
ACTIVE_STATES = ["IDLE", "LOADING_DATA", "TRAINING", "CHECKPOINTING", "RECOVERING"]
COUNTED_ACTIVE = ["TRAINING", "IDLE"]
API_STATUS = {"IDLE": "idle", "TRAINING": "active", "ERROR": "failed"}
MAX_WORKERS = 10_000
HEARTBEAT_TIMEOUT_S = 30
TASK_PATTERN = r"^(\w+)_([A-Z]+)_?"


def seconds_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1_000_000


def rank_workers(workers: DataFrame, order: str = "registered_at") -> DataFrame:
    """Ranks from 0 by arrival. The registry cap keeps this window small."""
    w = Window.orderBy(order, "worker_id")
    return workers.withColumn("rank", (F.row_number().over(w) - 1).cast("bigint"))


def register_workers(log: DataFrame, max_workers: int = MAX_WORKERS) -> DataFrame:
    """Every registration request with its rank or the reason it was refused.

    ``log`` has (worker_id, ts, event_id). The first request of an id counts
    while the registry has room. Once it is full every further request is refused
    for that, known ids included; before, a repeat is refused as a duplicate.
    """
    first = log.groupBy("worker_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    # The cap turns the ranking into a bounded top list, whatever the log holds.
    top = first.orderBy("first").limit(max_workers).select("worker_id", "first.*")
    place = F.row_number().over(Window.orderBy("ts", "event_id")) - 1
    accepted = top.select("worker_id", place.cast("bigint").alias("place"), F.col("event_id").alias("first_id"))
    last = F.when(F.count(F.lit(1)) == max_workers, F.max(F.struct("ts", "event_id")))
    full = top.agg(last.alias("full_at")).withColumn("one", F.lit(1))
    joined = log.join(F.broadcast(accepted), "worker_id", "left").withColumn("one", F.lit(1)).join(F.broadcast(full), "one")
    turned_down = F.col("place").isNull() | (F.col("event_id") != F.col("first_id"))
    reason = F.when(turned_down & (F.struct("ts", "event_id") > F.col("full_at")), "max_workers_reached").when(turned_down, "already_registered")
    return joined.select(
        "event_id",
        "worker_id",
        "ts",
        reason.isNull().alias("accepted"),
        reason.alias("reason"),
        F.when(reason.isNull(), F.col("place")).alias("rank"),
    )


def world_size_at_registration(changes: DataFrame) -> DataFrame:
    """Membership after each change; ``changes`` has (ts, event_id, worker_id, delta)."""
    return ordered(changes, [], ["ts", "event_id"], sums={"world_size": "delta"})


def compact_ranks(workers: DataFrame, removed: DataFrame) -> DataFrame:
    """Drop the removed workers and rank the rest by id, as text."""
    rest = workers.join(small(removed.select("worker_id")), "worker_id", "left_anti")
    w = Window.orderBy("worker_id")  # at most MAX_WORKERS rows
    return rest.withColumn("rank", (F.row_number().over(w) - 1).cast("bigint"))


def latest_heartbeat(heartbeats: DataFrame, columns=("state", "cpu_percent", "memory_used_bytes")) -> DataFrame:
    """Newest values per worker; combines before the shuffle."""
    newest = F.max_by(F.struct("ts", "event_id", *columns), F.struct("ts", "event_id"))
    return heartbeats.groupBy("worker_id").agg(newest.alias("h")).select("worker_id", "h.*")


def unknown_workers(heartbeats: DataFrame, registered: DataFrame) -> DataFrame:
    """Heartbeats of workers that never registered."""
    return heartbeats.join(small(registered.select("worker_id")), "worker_id", "left_anti")


def latest_progress(heartbeats: DataFrame) -> DataFrame:
    """Newest step and epoch; the optional task keeps its last given value."""
    at = F.struct("ts", "event_id")
    task_at = F.when(F.col("current_task").isNotNull(), at)
    return heartbeats.groupBy("worker_id").agg(
        F.max_by("current_step", at).alias("current_step"),
        F.max_by("current_epoch", at).alias("current_epoch"),
        F.max_by("current_task", task_at).alias("current_task"),
    )


def decode_state(code: Column) -> Column:
    """Wire code to state name; unknown codes and missing ones have defaults."""
    case = F.when(code.isNull(), MISSING_STATE)
    for number, name in WIRE_STATES.items():
        case = case.when(code == number, name)
    return case.otherwise(UNKNOWN_CODE_STATE)


def api_status(state: Column) -> Column:
    case = F.when(state.isNull(), "unknown")
    for name, status in API_STATUS.items():
        case = case.when(state == name, status)
    return case.otherwise("unknown")


def is_active(state: Column) -> Column:
    return state.isin(ACTIVE_STATES)


def active_workers(latest: DataFrame) -> DataFrame:
    active = latest.filter(is_active(F.col("state")))
    return active.withColumn("can_accept_work", F.col("state") == "IDLE")


def worker_counts(latest: DataFrame) -> DataFrame:
    return latest.agg(
        F.count_if(F.col("state").isin(COUNTED_ACTIVE)).alias("active_workers"),
        F.count(F.lit(1)).alias("total_workers"),
    )


def dead_workers(latest: DataFrame, as_of: Column, timeout_s: float = HEARTBEAT_TIMEOUT_S) -> DataFrame:
    """Workers silent for more than the timeout and not yet marked dead."""
    silent = seconds_between(F.col("ts"), as_of)
    return latest.withColumn("silent_s", silent).filter((F.col("silent_s") > timeout_s) & (F.col("state") != "DEAD"))


def evict_dead(workers: DataFrame, dead: DataFrame) -> DataFrame:
    """All workers: evicted ones flagged, the rest with their new ranks."""
    rest = compact_ranks(workers.select("worker_id"), dead).select("worker_id", F.col("rank").alias("new_rank"))
    both = workers.join(rest, "worker_id", "left")
    return both.withColumn("evicted", F.col("new_rank").isNull())


def aggregate_resources(latest: DataFrame, gpus: DataFrame) -> DataFrame:
    """Sums over active workers, with the GPU readings of all of them.

    CPU percentages are summed, not averaged, as the service does. ``latest``
    holds one row per worker, so the joined GPU list is bounded by the registry.
    """
    active = latest.filter(is_active(F.col("state")))
    joined = active.join(gpus.select("worker_id", "gpus"), "worker_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("workers"),
        F.sum("cpu_percent").alias("cpu_percent"),
        F.sum("memory_used_bytes").alias("memory_used_bytes"),
        F.flatten(F.collect_list("gpus")).alias("gpus"),
    )


def gpu_stats(readings: DataFrame, by=("worker_id", "gpu_id")) -> DataFrame:
    """Readings, mean use, hottest value and memory share per GPU."""
    each = readings.select("worker_id", F.explode("gpus").alias("g")).select("worker_id", "g.*")
    share = F.sum("memory_used_bytes") / F.sum("memory_total_bytes")
    return each.groupBy(*by).agg(
        F.count(F.lit(1)).alias("readings"),
        F.round(F.avg("utilization_percent"), 6).alias("avg_utilization"),
        F.round(F.max("temperature_celsius"), 6).alias("max_temperature"),
        F.round(share, 6).alias("memory_share"),
    )


def parse_task(heartbeats: DataFrame) -> DataFrame:
    """Split the task text into action and symbol; other texts give nulls."""
    matches = F.col("current_task").rlike(TASK_PATTERN)
    return heartbeats.withColumns(
        {
            "action": F.when(matches, F.regexp_extract("current_task", TASK_PATTERN, 1)),
            "symbol": F.when(matches, F.regexp_extract("current_task", TASK_PATTERN, 2)),
        }
    )


def task_activity(heartbeats: DataFrame) -> DataFrame:
    parsed = parse_task(heartbeats).filter("action is not null")
    return parsed.groupBy("action", "symbol").agg(
        F.count(F.lit(1)).alias("heartbeats"),
        F.max_by("current_step", F.struct("ts", "event_id")).alias("latest_step"),
    )


def heartbeat_gaps(heartbeats: DataFrame, timeout_s: float = HEARTBEAT_TIMEOUT_S, slices: int | None = None) -> DataFrame:
    """Longest silence and number of silences over the timeout per worker."""
    slim = heartbeats.select("worker_id", "ts", "event_id")
    linked = ordered(slim, ["worker_id"], ["ts", "event_id"], previous={"before": "ts"}, slices=slices)
    gap = linked.withColumn("gap_s", seconds_between(F.col("before"), F.col("ts")))
    return gap.groupBy("worker_id").agg(
        F.count(F.lit(1)).alias("heartbeats"),
        F.max("gap_s").alias("max_gap_s"),
        F.count_if(F.col("gap_s") > timeout_s).alias("gaps_over_timeout"),
    )


def stragglers(heartbeats: DataFrame, factor: float = 2.0) -> DataFrame:
    """Workers whose seconds per heartbeat exceed ``factor`` x the epoch's median.

    The rule is ours: pace = (last - first) / (heartbeats - 1) in one epoch. The
    median runs over at most one row per worker and epoch.
    """
    pace = heartbeats.groupBy("current_epoch", "worker_id").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("heartbeats")
    )
    pace = pace.withColumn("pace_s", F.try_divide(seconds_between(F.col("first"), F.col("last")), F.col("heartbeats") - 1))
    median = pace.groupBy("current_epoch").agg(F.median("pace_s").alias("median_s"))
    joined = pace.join(median, "current_epoch")
    return joined.filter(F.col("pace_s") > F.col("median_s") * factor).select(
        "current_epoch", "worker_id", "heartbeats", "pace_s", "median_s"
    )
