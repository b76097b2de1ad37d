"""Checkpoint catalogue, retention, recovery, write status and policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.operators.epochs import shard_assignment
from shardloom.operators.ordered import ordered
from shardloom.operators.workers import seconds_between

# Checkpoints kept, and entries of the public listing.
KEEP_COUNT = 5
LISTING_LIMIT = 20
NOTIFIED = ("notified_at", "notification")


def validate_checkpoints(df: DataFrame) -> DataFrame:
    """Add ``reason``, the first failed rule; null for valid notifications."""
    reason = (
        F.when(F.coalesce(F.length("worker_id"), F.lit(0)) == 0, "worker_id_empty")
        .when(F.coalesce(F.length("checkpoint_id"), F.lit(0)) == 0, "checkpoint_id_empty")
        .when(F.col("step") < 0, "step_negative")
        .when(F.col("size_bytes") < 0, "size_negative")
    )
    return df.withColumn("reason", reason)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter("reason is null").drop("reason")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter("reason is not null")


def checkpoint_catalogue(notices: DataFrame, key: Sequence[str] = ("step",)) -> DataFrame:
    """Last notification per key, its worker in the metadata, and how many it replaced."""
    keys = list(key)
    others = [c for c in notices.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*NOTIFIED)).alias("c")
    kept = notices.groupBy(*keys).agg(newest, (F.count(F.lit(1)) - 1).alias("overwritten"))
    kept = kept.select(*keys, "c.*", "overwritten")
    own = F.map_filter("metadata", lambda k, _: k != "worker_id")
    worker = F.create_map(F.lit("worker_id"), F.col("worker_id"))
    return kept.withColumn("metadata", F.map_concat(F.coalesce(own, F.create_map().cast("map<string,string>")), worker))


def retain_checkpoints(catalogue: DataFrame, keep: int = KEEP_COUNT) -> DataFrame:
    """The ``keep`` largest steps; equal to evicting the smallest one by one."""
    return catalogue.orderBy(F.desc("step")).limit(keep)


def eviction_plan(catalogue: DataFrame, keep: int = KEEP_COUNT) -> DataFrame:
    """Files to delete: everything below the ``keep`` largest steps."""
    kept = retain_checkpoints(catalogue.select("step"), keep)
    return catalogue.join(F.broadcast(kept), "step", "left_anti")


def latest_checkpoint(catalogue: DataFrame) -> DataFrame:
    return retain_checkpoints(catalogue, 1)


def checkpoint_by_step(catalogue: DataFrame, step: int) -> DataFrame:
    return catalogue.filter(F.col("step") == step)


def list_checkpoints(catalogue: DataFrame, limit: int = LISTING_LIMIT) -> DataFrame:
    """The first entries by step as the listing shows them."""
    shown = catalogue.orderBy("step").limit(limit)
    return shown.select(
        F.col("checkpoint_id").alias("id"),
        "step",
        "epoch",
        F.col("size_bytes").alias("size"),
        "path",
        F.coalesce(F.try_element_at("metadata", F.lit("worker_id")), F.lit("")).alias("worker_id"),
        F.lit("completed").alias("status"),
    )


def recovery_point(catalogue: DataFrame) -> DataFrame:
    """Exactly one row: where to resume, or has_checkpoint = false."""
    best = F.max_by(F.struct("checkpoint_id", "step", "epoch", "path", "size_bytes", "metadata"), "step").alias("c")
    zero = F.lit(0).cast("bigint")
    return catalogue.agg(best).select(
        F.col("c").isNotNull().alias("has_checkpoint"),
        F.col("c.checkpoint_id").alias("checkpoint_id"),
        F.coalesce("c.step", zero).alias("resume_step"),
        F.coalesce("c.epoch", zero).alias("resume_epoch"),
        F.col("c.path").alias("checkpoint_path"),
        F.col("c.size_bytes").alias("checkpoint_bytes"),
        F.col("c.metadata").alias("metadata"),
    )


def recovery_plan(catalogue: DataFrame, manifest: DataFrame, ranked: DataFrame, worker_id: str) -> DataFrame:
    """The recovery point, where it is stored, and all shards of one worker at its epoch with their files' place.

    ``manifest`` needs the ``path`` of each dataset, as ``dataset_manifest`` gives it.
    """
    epoch = catalogue.agg(F.max_by("epoch", "step")).scalar()
    epochs = manifest.select("dataset_id", epoch.alias("epoch")).filter("epoch is not null")
    plan = shard_assignment(manifest, ranked, epochs).filter(F.col("worker_id") == worker_id)
    plan = plan.select("dataset_id", "epoch", "shard_id", "total_shards", "start_index", "end_index")
    plan = plan.join(manifest.select("dataset_id", F.col("path").alias("dataset_path")), "dataset_id")
    point = recovery_point(catalogue)
    return point.join(plan, point["resume_epoch"] == plan["epoch"], "left").drop("epoch")


def write_status(events: DataFrame) -> DataFrame:
    """Current status per write; ids that were never pending are unknown."""
    at = F.struct("ts", "event_id")
    newest = F.max_by(F.struct("status", "error", "ts"), at).alias("e")
    folded = events.groupBy("checkpoint_id").agg(newest, F.max(F.col("status") == "Pending").alias("known"))
    return folded.select("checkpoint_id", "e.*", "known")


def known_writes(status: DataFrame) -> DataFrame:
    return status.filter("known").drop("known")


def unknown_writes(events: DataFrame) -> DataFrame:
    """Writes that were reported on before they were pending, or never were, with the last such report.

    Those reports are what a service drops as unknown at the time they come.
    """
    at = F.struct("ts", "event_id")
    starts = events.filter("status = 'Pending'").groupBy("checkpoint_id").agg(F.min(at).alias("started"))
    early = events.join(starts, "checkpoint_id", "left").filter(F.col("started").isNull() | (at < F.col("started")))
    return early.groupBy("checkpoint_id").agg(F.max_by("status", at).alias("status"))


def pending_summary(status: DataFrame) -> DataFrame:
    """One row: writes still open, done and failed."""
    return status.agg(
        F.count_if(F.col("status").isin("Pending", "InProgress")).alias("open"),
        F.count_if(F.col("status") == "Completed").alias("completed"),
        F.count_if(F.col("status") == "Failed").alias("failed"),
    )


def pending_failures(status: DataFrame) -> DataFrame:
    """One line ``id: error`` per failed write."""
    failed = status.filter("status = 'Failed'")
    text = F.concat_ws(": ", "checkpoint_id", F.coalesce("error", F.lit("unknown error")))
    return failed.select("checkpoint_id", text.alias("message"))


def checkpoint_throughput(notices: DataFrame, width: str = "1 minute") -> DataFrame:
    """Checkpoints and bytes per tumbling window, and bytes per second."""
    span = F.window("notified_at", width)
    per = notices.groupBy(span.alias("w")).agg(F.count(F.lit(1)).alias("checkpoints"), F.sum("size_bytes").alias("bytes"))
    seconds = seconds_between(F.col("w.start"), F.col("w.end"))
    return per.select(
        F.col("w.start").alias("window_start"),
        "checkpoints",
        "bytes",
        (F.col("bytes") / seconds).alias("bytes_per_s"),
    )


def due_by_steps(steps: DataFrame, interval: int) -> DataFrame:
    """Steps at which the every-N-steps policy saves."""
    return steps.filter((F.col("step") > 0) & (F.col("step") % interval == 0))


def due_by_time(steps: DataFrame, interval: str) -> DataFrame:
    """The first step of each run in each time bucket."""
    first = F.min(F.struct("ts", "event_id")).alias("first")
    due = steps.groupBy("run", F.window("ts", interval).alias("w")).agg(first)
    return due.select("run", F.col("w.start").alias("bucket"), "first.*")


def best_checkpoint(metrics: DataFrame, slices: int | None = None) -> DataFrame:
    """Rows of (run, ts, event_id, accuracy) that strictly beat all earlier ones.

    The best accuracy starts at 0.
    """
    seen = ordered(
        metrics, ["run"], ["ts", "event_id"], max_before={"best_before": "accuracy"}, slices=slices
    )
    best = F.greatest(F.col("best_before"), F.lit(0.0))
    return seen.filter(F.col("accuracy") > F.coalesce(best, F.lit(0.0))).drop("best_before")


def table_delta(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changed entries between two versions: ``op`` and the new values."""
    keys = list(keys)
    values = [c for c in base.columns if c not in keys]
    old = base.select(F.struct(*keys).alias("old_key"), F.struct(*values).alias("old"))
    fresh = new.select(F.struct(*keys).alias("new_key"), F.struct(*values).alias("new"))
    both = old.join(fresh, _same_keys("old_key", "new_key", keys), "full")
    op = (
        F.when(F.col("old_key").isNull(), "insert")
        .when(F.col("new_key").isNull(), "delete")
        .when(~F.col("old").eqNullSafe(F.col("new")), "update")
    )
    changed = both.withColumn("op", op).filter("op is not null")
    named = [F.coalesce(F.col(f"new_key.{k}"), F.col(f"old_key.{k}")).alias(k) for k in keys]
    return changed.select(*named, "op", *[F.col(f"new.{c}").alias(c) for c in values])


def _same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equal in all keys, null to null; the structs themselves are null for a missing side."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return same


def apply_delta(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The new version from the old one and a delta."""
    keys = list(keys)
    kept = base.select(F.struct(*base.columns).alias("b"))
    gone = delta.select(F.struct(*keys).alias("d"))
    untouched = kept.join(gone, _same_keys("b", "d", keys), "left_anti").select("b.*")
    changed = delta.filter("op <> 'delete'").select(*base.columns)
    return untouched.unionByName(changed)


def checkpoint_sizes(catalogue: DataFrame) -> DataFrame:
    """Count and bytes by worker and epoch, with subtotals and a grand total."""
    return catalogue.rollup("worker_id", "epoch").agg(
        F.count(F.lit(1)).alias("checkpoints"),
        F.sum("size_bytes").alias("bytes"),
        F.max("size_bytes").alias("largest"),
        F.grouping_id().cast("bigint").alias("level"),
    )


