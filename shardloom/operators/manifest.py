"""Dataset manifest, shard ranges and plan snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shardloom.sources.tables import DatasetSpec, load


def dataset_manifest(spark: SparkSession, specs: Sequence[DatasetSpec]) -> DataFrame:
    """One row per registered dataset with its row count and number of shards.

    A repeated id replaces the earlier registration.
    """
    latest = list({spec.dataset_id: spec for spec in specs}.values())
    declared = spark.createDataFrame(
        pa.Table.from_pylist(
            [
                {
                    "n": n,
                    "dataset_id": spec.dataset_id,
                    "path": spec.path,
                    "format": spec.format,
                    "shard_size": spec.shard_size,
                    "shuffle": spec.shuffle,
                    "seed": spec.seed,
                }
                for n, spec in enumerate(latest)
            ]
        )
    )
    # One job counts all datasets: rows shrink to one count per task and dataset.
    rows = [row_source(spark, spec).select(F.lit(n).cast("bigint").alias("n")) for n, spec in enumerate(latest)]
    counts = reduce(DataFrame.union, rows).groupBy("n").agg(F.count(F.lit(1)).alias("counted"))
    total = F.coalesce("counted", F.lit(0).cast("bigint"))
    # One row per declared dataset, so the counts are as small as the declaration.
    return declared.join(F.broadcast(counts), "n", "left").select(
        "dataset_id",
        "path",
        "format",
        total.alias("total_samples"),
        "shard_size",
        "shuffle",
        "seed",
        F.ceil(total / F.col("shard_size")).cast("bigint").alias("total_shards"),
    )


def row_source(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """The rows of a dataset for counting; parquet needs no column and no schema job."""
    if spec.format == "parquet":
        return load(spark, spec.format, spec.path, StructType([]))
    return load(spark, spec.format, spec.path, spec.schema)


def dataset_listing(manifest: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """The listing shown to users; ``dataset_id`` looks up one entry."""
    listing = manifest.select(
        F.col("dataset_id").alias("id"),
        F.col("dataset_id").alias("name"),
        "total_samples",
        "shard_size",
        F.col("total_shards").alias("shard_count"),
        "format",
        "shuffle",
    )
    return listing if dataset_id is None else listing.filter(F.col("id") == dataset_id)


def shard_ranges(manifest: DataFrame) -> DataFrame:
    """All shards with [start_index, end_index); the last one may be short."""
    shards = manifest.filter("total_shards > 0").select(
        "dataset_id",
        "total_samples",
        "shard_size",
        "total_shards",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total_shards") - 1)).alias("shard_id"),
    )
    start = F.col("shard_id") * F.col("shard_size")
    end = F.least(start + F.col("shard_size"), F.col("total_samples"))
    return shards.select(
        "dataset_id",
        "shard_id",
        "total_shards",
        start.alias("start_index"),
        end.alias("end_index"),
        (end - start).alias("num_samples"),
    )


JSON_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def state_snapshot(manifest: DataFrame, epochs: DataFrame, workers: DataFrame, ring: DataFrame | None = None) -> DataFrame:
    """The planning state as JSON lines, one per dataset, worker and virtual node of the ring."""
    datasets = manifest.join(epochs.select("dataset_id", "current_epoch"), "dataset_id", "left")
    datasets = datasets.withColumn("current_epoch", F.coalesce("current_epoch", F.lit(0).cast("bigint")))

    def lines(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*sorted(df.columns)), JSON_TIMES).alias("state"))

    both = lines(datasets, "dataset").unionByName(lines(workers, "worker"))
    return both if ring is None else both.unionByName(lines(ring, "ring"))


def restore(snapshot: DataFrame, kind: str, schema: str) -> DataFrame:
    """Rebuild the table of one kind from a snapshot."""
    parsed = F.from_json("state", schema, JSON_TIMES)
    return snapshot.filter(F.col("kind") == kind).select(parsed.alias("row")).select("row.*")
