"""Epoch state, shuffled shard order and the assignment of shards to workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.functions.hashing import shuffle_key
from shardloom.operators.manifest import shard_ranges
from shardloom.operators.ordered import ordered
from shardloom.operators.ring import hash_ring, ring_assignment
from shardloom.session import small


def epoch_state(log: DataFrame, manifest: DataFrame) -> DataFrame:
    """Current epoch of every registered dataset from (dataset_id, op, epoch, ts, event_id).

    The last ``init`` sets the value and every later ``advance`` adds one; a
    dataset without events is at 0 and unregistered datasets drop out.
    """
    inits = log.filter("op = 'init'").groupBy("dataset_id")
    inits = inits.agg(F.max(F.struct("ts", "event_id", "epoch")).alias("init"))
    inits = inits.select(
        "dataset_id",
        F.col("init.ts").alias("init_ts"),
        F.col("init.event_id").alias("init_id"),
        F.col("init.epoch").alias("init_epoch"),
    )
    state = small(small(manifest).select("dataset_id").join(inits, "dataset_id", "left"))
    behind = F.struct("ts", "event_id") > F.struct("init_ts", "init_id")
    later = (
        log.filter("op = 'advance'")
        .join(state, "dataset_id")
        .filter(F.col("init_ts").isNull() | behind)
        .groupBy("dataset_id")
        .agg(F.count(F.lit(1)).alias("advances"))
    )
    current = F.coalesce("init_epoch", F.lit(0)) + F.coalesce("advances", F.lit(0))
    return state.join(later, "dataset_id", "left").select("dataset_id", current.cast("bigint").alias("current_epoch"))


def with_epochs(shards: DataFrame, epochs: int) -> DataFrame:
    """Repeat the shards for the epochs 0 .. epochs-1."""
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(epochs - 1).cast("bigint"))
    return shards.withColumn("epoch", F.explode(numbers))


def epoch_shard_order(shards: DataFrame, seeds: DataFrame, slices: int | None = None) -> DataFrame:
    """Add ``order_index``, the place of each shard in its epoch's shuffle."""
    keyed = shards.join(small(seeds).select("dataset_id", "seed"), "dataset_id")
    key = shuffle_key(F.col("seed"), F.col("dataset_id"), F.col("epoch"), F.col("shard_id"))
    keyed = keyed.withColumn("shuffle_key", key).drop("seed")
    placed = ordered(
        keyed, ["dataset_id", "epoch"], ["shuffle_key", "shard_id"], position="order_index", slices=slices
    )
    return placed.drop("shuffle_key")


def round_robin_assignment(order: DataFrame, ranked: DataFrame) -> DataFrame:
    """Position modulo the number of workers picks the rank; no workers, no rows."""
    ranked = small(ranked).select("worker_id", F.col("rank").cast("bigint").alias("rank"))
    workers = ranked.agg(F.count(F.lit(1))).scalar()
    turn = order.withColumn("rank", F.try_mod(F.col("order_index"), workers))
    return turn.join(ranked, "rank").drop("rank")


def shard_assignment(manifest: DataFrame, ranked: DataFrame, epochs: int | DataFrame) -> DataFrame:
    """Every shard of every epoch with its worker and ``order_index``.

    Shuffled datasets go round robin over the epoch's order, the others by the
    ring; there the order is by shard id and the same in each epoch. ``epochs``
    is a number of epochs or a table (dataset_id, epoch).
    """
    manifest = small(manifest)
    ranked = small(ranked)
    kinds = manifest.select("dataset_id", "shuffle")
    shards = shard_ranges(manifest)
    if isinstance(epochs, int):
        planned = with_epochs(shards, epochs)
    else:
        planned = shards.join(small(epochs.select("dataset_id", "epoch")), "dataset_id")
    planned = planned.join(kinds, "dataset_id")
    shuffled = epoch_shard_order(planned.filter("shuffle"), manifest)
    by_turn = round_robin_assignment(shuffled, ranked)
    ring = hash_ring(ranked, inserted="rank")
    by_ring = ring_assignment(planned.filter("not shuffle"), ring).withColumn("order_index", F.col("shard_id"))
    columns = [
        "dataset_id", "epoch", "shard_id", "worker_id", "order_index",
        "total_shards", "start_index", "end_index", "num_samples",
    ]
    return by_turn.select(columns).unionByName(by_ring.filter("worker_id is not null").select(columns))


def first_shard(assignment: DataFrame) -> DataFrame:
    """The first shard of each worker, dataset and epoch, as a single answer."""
    groups = ["dataset_id", "epoch", "worker_id"]
    # A minimum combines before the shuffle, so long shard lists cost nothing.
    rest = [c for c in assignment.columns if c not in groups + ["order_index"]]
    first = F.min(F.struct("order_index", *rest)).alias("first")
    return assignment.groupBy(*groups).agg(first).select(*groups, "first.*")


def rebalance(manifest: DataFrame, ranked: DataFrame, log: DataFrame) -> DataFrame:
    """The assignment of all datasets at their current epochs, one row per shard."""
    current = epoch_state(log, manifest).withColumnRenamed("current_epoch", "epoch")
    plan = shard_assignment(manifest, ranked, current)
    return plan.select("worker_id", "dataset_id", "epoch", "shard_id")


def assignment_audit(manifest: DataFrame, assignment: DataFrame) -> DataFrame:
    """Per dataset and epoch: missing and repeated shards, and samples covered."""
    epochs = assignment.select("epoch").distinct()
    shards = shard_ranges(manifest)
    given = assignment.groupBy("dataset_id", "epoch", "shard_id").agg(F.count(F.lit(1)).alias("times"))
    lists = epochs.agg(F.collect_set("epoch")).scalar()
    wanted = shards.select("dataset_id", "shard_id", "num_samples").withColumn("epoch", F.explode(lists))
    both = wanted.join(given, ["dataset_id", "epoch", "shard_id"], "full")
    covered = F.when(F.col("times") > 0, F.col("num_samples"))
    return both.groupBy("dataset_id", "epoch").agg(
        F.count("num_samples").alias("shards"),
        F.count_if(F.col("times").isNull()).alias("missing_shards"),
        F.count_if(F.col("times") > 1).alias("repeated_shards"),
        F.count_if(F.col("num_samples").isNull()).alias("unknown_shards"),
        F.coalesce(F.sum(covered), F.lit(0)).alias("covered_samples"),
    )


def multi_epoch_load(assignment: DataFrame) -> DataFrame:
    """Shards and samples of each worker per dataset and epoch."""
    return assignment.groupBy("dataset_id", "epoch", "worker_id").agg(
        F.count(F.lit(1)).alias("shards"), F.sum("num_samples").alias("samples")
    )


def capacity_assignment(manifest: DataFrame, workers: DataFrame, weight: str = "gpu_count") -> DataFrame:
    """Shard counts per worker in proportion to capacity, by largest remainder.

    Each worker gets the whole part of its share; the shards left over go to the
    largest remainders, ties to the smaller worker id. The rule is exact integer
    arithmetic, and its result has one row per worker and dataset.
    """
    workers = small(workers.select("worker_id", F.col(weight).cast("bigint").alias("weight")))
    capacity = workers.agg(F.sum("weight")).scalar()
    names = workers.agg(F.collect_list(F.struct("worker_id", "weight"))).scalar()
    shares = manifest.select("dataset_id", "total_shards", F.explode(names).alias("w"), capacity.alias("capacity"))
    product = F.col("total_shards") * F.col("w.weight")
    shares = shares.select(
        "dataset_id",
        "total_shards",
        F.col("w.worker_id").alias("worker_id"),
        F.col("w.weight").alias("weight"),
        F.try_mod(product, F.col("capacity")).alias("remainder"),
        product.alias("product"),
        "capacity",
    )
    whole = F.try_divide(F.col("product") - F.col("remainder"), F.col("capacity")).cast("bigint")
    shares = shares.withColumn("whole", whole)
    # One group per dataset, as long as the worker list (capped by the registry).
    largest = Window.partitionBy("dataset_id").orderBy(F.desc("remainder"), "worker_id")
    left = F.col("total_shards") - F.sum("whole").over(Window.partitionBy("dataset_id"))
    extra = F.when(F.row_number().over(largest) <= left, 1).otherwise(0)
    return shares.select("dataset_id", "worker_id", "weight", (F.col("whole") + extra).cast("bigint").alias("shards"))
