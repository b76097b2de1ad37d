"""What the physical plans must and must not contain."""

import re

from pyspark.sql import functions as F

from shardloom.operators import checkpoints, delivery, ring, tasks
from shardloom.plans.placement import plan_of, ring_of
from shardloom.session import work_folder
from shardloom.sources import views
from shardloom.sources.tables import table

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ring_lookup_broadcasts_the_ring(spark):
    keys = table(spark, SF_DIR, "lineitem").select(F.col("l_orderkey").cast("string").alias("k"))
    text = plan(ring.ring_lookup(keys, ring_of(spark, SF_DIR), "k"))
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "Cartesian" not in text


def test_read_shard_prunes_partitions(spark):
    path = work_folder(spark, "plans")
    delivery.write_sharded(delivery.shard_samples(table(spark, SF_DIR, "orders"), ["o_orderkey"], 100), path)
    assignment = plan_of(spark, SF_DIR, names=("orders",)).withColumn("worker_id", F.lit("w"))
    read = delivery.read_shard(spark, path, assignment.filter("shard_id < 3"), "w", 0)
    assert re.search(r"PartitionFilters: \[[^\]]*shard_id#\d+ IN \(0,1,2\)", plan(read))
    assert read.select("shard_id").distinct().count() == 3


def test_read_shard_lists_own_folders_only(spark, tmp_path):
    path = str(tmp_path / "sharded")
    delivery.write_sharded(spark.range(50).withColumn("shard_id", F.expr("id div 10")), path)
    # A foreign folder of another layout, which no listing of all folders gets past.
    spark.range(3).write.parquet(f"{path}/shard_id=7/x=1")
    plan_rows = [(0, "w", 0, 5), (3, "w", 0, 6), (1, "v", 0, 7), (4, "w", 1, 8)]
    assignment = spark.createDataFrame(plan_rows, "shard_id long, worker_id string, epoch long, order_index long")
    got = delivery.read_shard(spark, path, assignment, "w", 0).select("id", "shard_id", "order_index").collect()
    assert sorted(map(tuple, got)) == [(i, 0, 5) for i in range(10)] + [(i, 3, 6) for i in range(30, 40)]


def test_read_shard_without_some_folders(spark, tmp_path):
    path = str(tmp_path / "sharded")
    delivery.write_sharded(spark.range(50).withColumn("shard_id", F.expr("id div 10")), path)
    assignment = spark.createDataFrame([(2, "w", 0, 5), (9, "w", 0, 6)], "shard_id long, worker_id string, epoch long, order_index long")
    assert sorted(r.id for r in delivery.read_shard(spark, path, assignment, "w", 0).collect()) == list(range(20, 30))
    assert delivery.read_shard(spark, path, assignment, "nobody", 0).isEmpty()


def sample_windows(text):
    """Partition columns of the windows that read sample rows."""
    return [m for m in re.findall(r"Window \[row_number\(\)[^\n]*", text)]


def test_sample_windows_run_in_slices(spark):
    lines = table(spark, SF_DIR, "lineitem")
    sharded = delivery.shard_samples(lines, views.LINEITEM_ORDER, 100, slices=12)
    shuffled = delivery.shuffle_samples(table(spark, SF_DIR, "orders"), "o_orderkey", dataset="orders")
    for df in (sharded, shuffled):
        windows = sample_windows(plan(df))
        assert windows and all("__slice" in w for w in windows)


def test_top_k_does_not_sort_everything(spark):
    latest = checkpoints.latest_checkpoint(checkpoints.checkpoint_catalogue(views.checkpoints(spark, SF_DIR)))
    assert "TakeOrderedAndProject" in plan(latest)
    assert "TakeOrderedAndProject" in plan(tasks.recent_logs(views.logs(spark, SF_DIR)))


def test_scans_read_only_what_they_need(spark):
    text = plan(views.checkpoints(spark, SF_DIR).groupBy("worker_id").agg(F.sum("size_bytes")))
    assert re.search(r"ReadSchema: struct<o_custkey:bigint,o_totalprice:double>", text)
    found = tasks.search_logs(views.logs(spark, SF_DIR), source="error")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,error\)", plan(found))
