"""Hash trees of stored versions: equal contents, deltas of the changed buckets, limits."""

import random

import pytest
from pyspark.sql import functions as F

from shardloom.operators import checkpoints, versions
from shardloom.operators.packed import read_packed
from shardloom.session import work_folder
from tests.test_packed import scanned

SCHEMA = "k long, part string, x double, tags array<string>"


def stored(df, keys, **options):
    path = work_folder(df.sparkSession, "version")
    versions.write_version(df, keys, path, **options)
    return path


def root(spark, path):
    return spark.read.parquet(f"{path}/{versions.TREE}/root").first()


def test_one_changed_row_reads_its_bucket_alone(spark):
    base = spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("v"))
    new = base.withColumn("v", F.when(F.col("id") == 777, "new").otherwise(F.col("v")))
    old = stored(base, ["id"], bits=10, file_bytes=100_000)
    fresh = stored(new.repartition(5), ["id"], like=old)
    changed = versions.changed_buckets(spark, old, fresh)
    assert changed.count() == 1
    rows = read_packed(spark, old, changed, versions.BUCKET)
    assert len(rows.inputFiles()) == 1 and len(spark.read.parquet(old).inputFiles()) > 5
    bucket = changed.first()[0]
    # Ten thousand rows a page here, so the file's share bounds what leaves the scan.
    assert scanned(spark.read.parquet(*rows.inputFiles()).filter(F.col(versions.BUCKET) == bucket)) < 4_000
    assert [tuple(r) for r in versions.version_delta(spark, old, fresh, ["id"]).collect()] == [(777, "update", "new")]


def test_equal_rows_have_equal_trees(spark):
    base = spark.range(3_000).select("id", (F.col("id") % 7).alias("v"))
    paths = [stored(df, ["id"], bits=9) for df in (base, base.repartition(7, "v"), base.select("v", "id"))]
    assert len({root(spark, p) for p in paths}) == 1
    assert versions.version_delta(spark, paths[0], paths[1], ["id"]).count() == 0


@pytest.mark.parametrize("bits", [0, 3, 12])
def test_equals_the_full_join_with_nulls(spark, bits):
    rng = random.Random(bits)
    rows = [(k, p, rng.choice([None, 0.5, float("nan")]), rng.choice([None, [], ["a", None], [None, "a"]])) for k in [None, *range(200)] for p in (None, "a", "b")]
    later = [r for r in rows if rng.random() > 0.1]
    later = [(r[0], r[1], 9.0, r[3]) if rng.random() < 0.05 else (*r[:3], [None, "a"]) if r[3] == ["a", None] and rng.random() < 0.5 else r for r in later]
    later += [(1000 + i, None, None, None) for i in range(9)]
    base, new = (spark.createDataFrame(r, SCHEMA) for r in (rows, later))
    old = stored(base, ["k", "part"], bits=bits)
    fresh = stored(new, ["k", "part"], like=old)
    want = sorted(map(repr, checkpoints.table_delta(base, new, ["k", "part"]).collect()))
    assert sorted(map(repr, versions.version_delta(spark, old, fresh, ["k", "part"]).collect())) == want
    assert want


def test_from_and_to_an_empty_table(spark):
    rows = spark.createDataFrame([(1, "a", 0.5, ["x"]), (2, None, None, None)], SCHEMA)
    old = stored(rows.limit(0), ["k"], bits=4)
    fresh = stored(rows, ["k"], like=old)
    assert [(r.k, r.op) for r in versions.version_delta(spark, old, fresh, ["k"]).sort("k").collect()] == [(1, "insert"), (2, "insert")]
    assert [(r.k, r.op) for r in versions.version_delta(spark, fresh, old, ["k"]).sort("k").collect()] == [(1, "delete"), (2, "delete")]


def test_versions_that_do_not_compare(spark):
    rows = spark.range(10).select("id", F.lit(1).alias("v"))
    old = stored(rows, ["id"], bits=2)
    with pytest.raises(ValueError, match="like"):
        versions.changed_buckets(spark, old, stored(rows, ["id"], bits=3))
    with pytest.raises(ValueError, match="columns"):
        versions.version_delta(spark, old, stored(rows.withColumn("w", F.lit(1)), ["id"], like=old), ["id"])
