"""Packed shards: files by bytes, the index, and reads that touch their shards alone."""

import pytest
from pyspark.sql import functions as F

from shardloom.operators import delivery, packed
from shardloom.session import work_folder


def scanned(df):
    """Rows that left the file scans after a run of ``df``."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def written(spark):
    path = work_folder(spark, "packed")
    rows = spark.range(20_050).select("id", F.md5(F.col("id").cast("string")).alias("text"), F.array("id").alias("a"))
    data = delivery.shard_samples(rows, ["id"], 100)
    packed.write_packed(data, path, shard_rows=100, file_bytes=300_000)
    return path


def test_files_by_bytes_with_whole_shards(spark, written):
    index = packed.packed_index(spark, written).collect()
    assert sorted(r.id for r in index) == list(range(201))
    assert sum(r.num_rows for r in index) == 20_050
    # 72 to 77 bytes a row: eight numbers and texts of 32 and some 10 bytes.
    assert 4 <= len({r.file for r in index}) <= 6
    assert spark.read.parquet(written).count() == 20_050


def test_a_read_touches_its_shards_alone(spark, written):
    rows = spark.read.parquet(written).filter(packed._within("shard_id", [3, 77, 78, 200]))
    assert scanned(rows) == 350
    ids = spark.createDataFrame([(i,) for i in (3, 77, 78, 200, 3, 999)], "shard_id long")
    read = packed.read_packed(spark, written, ids)
    assert len(read.inputFiles()) <= 3
    got = read.groupBy("shard_id").count().collect()
    assert {r.shard_id: r["count"] for r in got} == {3: 100, 77: 100, 78: 100, 200: 50}
    whole = spark.range(201).select(F.col("id").alias("shard_id"))
    assert packed.read_packed(spark, written, whole).count() == 20_050
    assert packed.read_packed(spark, written, whole.filter("shard_id < 0")).count() == 0


def test_more_ids_than_the_driver_takes(spark, written, monkeypatch):
    monkeypatch.setattr(packed, "MAX_IDS", 3)
    ids = spark.range(0, 200, 20).select(F.col("id").alias("shard_id"))
    assert packed.read_packed(spark, written, ids).count() == 1000


def test_one_worker_reads_in_its_order(spark, written):
    plan = spark.createDataFrame([(5, "w", 0, 1), (9, "w", 0, 0), (6, "v", 0, 0), (7, "w", 1, 0)], "shard_id long, worker_id string, epoch long, order_index long")
    rows = packed.read_packed_shard(spark, written, plan, "w", 0).select("order_index", "id").collect()
    assert sorted((r.order_index, r.id) for r in rows) == [(0, i) for i in range(900, 1000)] + [(1, i) for i in range(500, 600)]


def test_runs_of_ids():
    assert packed.id_ranges([4]) == [(4, 4)]
    assert packed.id_ranges([1, 2, 3, 7, 9, 10]) == [(1, 3), (7, 7), (9, 10)]
    assert packed.id_ranges([1, 2, 3, 7, 9, 10], 2) == [(1, 3), (7, 10)]
    assert packed.id_ranges([1, 5, 9], 1) == [(1, 9)]


def test_an_empty_table(spark):
    path = work_folder(spark, "packed")
    packed.write_packed(spark.createDataFrame([], "shard_id long, sample_idx long, text string"), path)
    assert packed.packed_index(spark, path).count() == 0
    assert packed.read_packed(spark, path, spark.createDataFrame([(1,)], "shard_id long")).count() == 0
