"""Consistent-hash placement of shards and of keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.functions.hashing import POSITIONS

VIRTUAL_NODES = 150  # fixed value: points of each worker on the ring
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def hash_ring(workers: DataFrame, vnodes: int = VIRTUAL_NODES, hash: str = "fnv", inserted: str = "worker_id") -> DataFrame:
    """Ring points (worker_id, vnode, position); a repeated worker counts once.

    When two points collide, the worker inserted later holds the position;
    ``inserted`` names the column that gives the order of insertion.
    """
    nodes = workers.groupBy("worker_id").agg(F.min(inserted).alias("inserted"))
    points = nodes.select("worker_id", "inserted", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("vnode"))
    key = F.concat_ws(":", "worker_id", F.col("vnode").cast("string"))
    points = points.withColumn("position", POSITIONS[hash](key))
    last = Window.partitionBy("position").orderBy(F.desc("inserted"), F.desc("vnode"))
    return (
        points.withColumn("rank", F.row_number().over(last))
        .filter("rank = 1")
        .select("worker_id", F.col("vnode").cast("bigint").alias("vnode"), "position")
    )


def ring_arcs(ring: DataFrame, bits: int) -> DataFrame:
    """Arcs [low, high] of the ring per worker, repeated per hash bucket they touch."""
    # The ring has workers x vnodes points (the registry caps the workers), so
    # this one window stays small whatever the size of the keyed data.
    along = Window.orderBy("position")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    points = ring.select(
        "worker_id",
        "position",
        F.lag("position").over(along).alias("before"),
        F.last("position").over(whole).alias("last"),
    )
    arc = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    own = arc(F.coalesce(F.col("before") + 1, F.lit(LOWEST)), F.col("position"))
    # The first point also takes the keys behind the last one.
    wrap = F.when(
        F.col("before").isNull() & (F.col("last") < HIGHEST), F.array(own, arc(F.col("last") + 1, F.lit(HIGHEST)))
    )
    arcs = points.select("worker_id", F.explode(F.coalesce(wrap, F.array(own))).alias("arc")).select("worker_id", "arc.*")
    bucket = lambda c: F.shiftright(c, 64 - bits)
    return arcs.withColumn("bucket", F.explode(F.sequence(bucket("low"), bucket("high"))))


def ring_lookup(
    keys: DataFrame, ring: DataFrame, key: str | Column, *, hash: str = "fnv", bits: int = 14, broadcast_arcs: bool = True
) -> DataFrame:
    """Add ``worker_id``, the owner of each key; null when the ring is empty.

    The nearest-point search becomes an equi join on the top ``bits`` of the
    hash plus a residual range test. Buckets are hash prefixes, so even one key
    with a third of all rows meets a broadcast table and shuffles nothing.
    Set ``broadcast_arcs=False`` for rings beyond the worker cap.
    """
    arcs = ring_arcs(ring, bits)
    if broadcast_arcs:
        arcs = F.broadcast(arcs)
    column = F.col(key) if isinstance(key, str) else key
    placed = keys.withColumn("__at", POSITIONS[hash](column))
    placed = placed.withColumn("__bucket", F.shiftright("__at", 64 - bits))
    inside = (F.col("__bucket") == F.col("bucket")) & F.col("__at").between(F.col("low"), F.col("high"))
    return placed.join(arcs, inside, "left").drop("__at", "__bucket", "bucket", "low", "high")


def ring_assignment(shards: DataFrame, ring: DataFrame, **options) -> DataFrame:
    """Owner of every shard, by the key ``dataset:shard``."""
    key = F.concat_ws(":", "dataset_id", F.col("shard_id").cast("string"))
    return ring_lookup(shards, ring, key, **options)


def shards_for_node(assignment: DataFrame, worker_id: str) -> DataFrame:
    return assignment.filter(F.col("worker_id") == worker_id)


def place_rows_on_ring(df: DataFrame, ring: DataFrame, key: str | Column, *, spread: int = 0, **options) -> DataFrame:
    """Place keyed rows; ``spread`` > 0 also co-locates them by worker.

    A worker may own far more rows than another, so delivery splits each worker
    into ``spread`` parts instead of sending it to a single task.
    """
    placed = ring_lookup(df, ring, key, **options)
    if spread:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(spread))
        placed = placed.withColumn("part", part).repartition("worker_id", "part")
    return placed


def ring_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """Shards whose owner differs between two assignments."""
    pairs = _pairs(before, after)
    return pairs.filter(~F.col("from_worker").eqNullSafe(F.col("to_worker")))


def eviction_moves(shards: DataFrame, ring: DataFrame, dead: DataFrame) -> DataFrame:
    """What an eviction moves: each shard of a dead worker with its new owner on the ring of the rest."""
    rest = ring.join(dead.select("worker_id"), "worker_id", "left_anti")
    return ring_moves(ring_assignment(shards, ring), ring_assignment(shards, rest))


def _pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    old = before.select("dataset_id", "shard_id", F.col("worker_id").alias("from_worker"))
    new = after.select("dataset_id", "shard_id", F.col("worker_id").alias("to_worker"))
    return old.join(new, ["dataset_id", "shard_id"], "full")


def ring_net_loss(before: DataFrame, after: DataFrame) -> DataFrame:
    """Shards before and after per worker, and how many it lost on balance."""
    pairs = _pairs(before, after)
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("from_worker").alias("worker_id"), F.lit(1).alias("old"), F.lit(0).alias("new")),
                F.struct(F.col("to_worker").alias("worker_id"), F.lit(0).alias("old"), F.lit(1).alias("new")),
            )
        ).alias("side")
    ).select("side.*")
    counts = sides.filter("worker_id is not null").groupBy("worker_id")
    counts = counts.agg(F.sum("old").alias("shards_before"), F.sum("new").alias("shards_after"))
    loss = F.greatest(F.col("shards_before") - F.col("shards_after"), F.lit(0).cast("bigint"))
    return counts.withColumn("net_loss", loss)


def ring_retention(before: DataFrame, after: DataFrame) -> DataFrame:
    """Share of its earlier shards each remaining worker keeps."""
    pairs = _pairs(before, after).join(after.select(F.col("worker_id").alias("from_worker")).distinct(), "from_worker", "left_semi")
    kept = F.count_if(F.col("from_worker") == F.col("to_worker"))
    return pairs.groupBy(F.col("from_worker").alias("worker_id")).agg(
        F.count(F.lit(1)).alias("shards_before"),
        kept.alias("shards_kept"),
        F.round(kept / F.count(F.lit(1)), 6).alias("kept_share"),
    )


def ring_counts(assignment: DataFrame, workers: DataFrame) -> DataFrame:
    """Shards per worker; workers without any count 0."""
    counts = assignment.groupBy("worker_id").agg(F.count(F.lit(1)).alias("shards"))
    return workers.select("worker_id").join(counts, "worker_id", "left").fillna(0, ["shards"])


def ring_balance(assignment: DataFrame, workers: DataFrame) -> DataFrame:
    """One row: how evenly the shards are spread over the workers."""
    mean = F.avg("shards")
    return ring_counts(assignment, workers).agg(
        F.count(F.lit(1)).alias("workers"),
        F.sum("shards").alias("shards"),
        F.round(mean, 6).alias("mean_shards"),
        F.round(F.stddev_pop("shards"), 6).alias("stddev_shards"),
        F.min("shards").alias("min_shards"),
        F.max("shards").alias("max_shards"),
        F.round(F.greatest(F.max("shards") - mean, mean - F.min("shards")) / mean, 6).alias("worst_deviation"),
    )


def ring_members(ring: DataFrame) -> DataFrame:
    """Workers on the ring with the number of points each holds."""
    return ring.groupBy("worker_id").agg(F.count(F.lit(1)).alias("points"))
