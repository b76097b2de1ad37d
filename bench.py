"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = [
    "shard_ranges", "index_samples", "shard_samples", "ring_lookup", "place_rows_on_ring", "ring_moves", "shard_assignment",
    "epoch_samples", "epoch_sample_rows", "shuffle_samples", "write_sharded", "read_shard", "normalize_features",
    "latest_heartbeat", "heartbeat_gaps", "register_workers", "barrier_arrivals", "barrier_wait_p99",
    "checkpoint_catalogue", "table_delta", "scan_checkpoints", "recovery_plan", "request_summary", "rate_limit",
    "sanitize_text", "task_logs", "overview", "windowed_loss", "training_rate", "reassemble",
    "stream_latest_heartbeat", "stream_barriers", "stream_rate_limit",
]
SIZES = [(10, 1_000), (100, 10_000), (1_000, 100_000)]


def timed(df) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def plan_times(spark) -> dict[str, float]:
    """Full assignment and move set at the published worker and shard counts."""
    from shardloom.operators import epochs, manifest, ring

    def workers(n):
        return spark.range(n).select(F.format_string("worker-%05d", "id").alias("worker_id"), F.col("id").alias("rank"))

    def datasets(shards, shuffle):
        row = spark.range(1).select(
            F.lit("dataset-1").alias("dataset_id"), F.lit(shards * 1000).cast("bigint").alias("total_samples"),
            F.lit(1000).cast("bigint").alias("shard_size"), F.lit(shuffle).alias("shuffle"),
            F.lit(42).cast("bigint").alias("seed"), F.lit(shards).cast("bigint").alias("total_shards"),
        )
        return row

    out = {}
    for n, shards in SIZES:
        for shuffle in (True, False):
            began = time.perf_counter()
            plan = epochs.shard_assignment(datasets(shards, shuffle), workers(n), 1)
            plan.write.format("noop").mode("overwrite").save()
            out[f"assign_{'shuffle' if shuffle else 'ring'}_{n}w_{shards}s"] = time.perf_counter() - began
    shards = manifest.shard_ranges(datasets(10_000, False))
    rings = [ring.hash_ring(workers(n), inserted="rank") for n in (100, 101)]
    out["move_set_100w_plus_1"] = timed(ring.ring_moves(*[ring.ring_assignment(shards, r) for r in rings]))
    return out


def container_times(spark) -> dict[str, float]:
    """Write 32 containers of 10 MB from a table, to the end of the last file."""
    from shardloom.session import settled, work_folder
    from shardloom.sources import containers

    text = F.repeat(F.lit("0123456789abcdef"), F.lit(10 * 65536))
    rows = spark.range(32).repartition(8).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("name"), "id", F.encode(text, "UTF-8").alias("data")
    )
    rows = settled(rows, "bench")
    notes = F.create_map(F.lit("k"), F.lit("v"))
    made = rows.select("name", containers.container(F.col("id"), F.lit(0), F.lit(0), notes, F.col("data")).alias("content"))
    began = time.perf_counter()
    containers.encode_checkpoint(made, work_folder(spark, "bench"))
    return {"write_containers_320mb": time.perf_counter() - began}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shardloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from shardloom.plans import catalog

    wanted = sys.argv[1:] or HEADLINE
    if wanted == ["all"]:
        wanted = list(catalog.QUERIES)
    # One small query starts the JVM code paths and the Python workers.
    timed(catalog.QUERIES["ring_lookup"](spark, sf_dir))
    seconds = {}
    for name in wanted:
        began = time.perf_counter()
        df = catalog.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    if not sys.argv[1:]:
        seconds.update({k: round(v, 3) for k, v in {**plan_times(spark), **container_times(spark)}.items()})
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
