"""Stored versions of a table with hash trees: a delta costs what changed.

Rows lie in buckets of their keys' hashes, many buckets per file (``packed``).
Beside them lies a tree: a leaf holds the row count and sums of row hashes of one
bucket, a node the sums over the hashes of its ``FANOUT`` children. Sums do not
depend on the order of rows, so equal contents have equal trees. Two versions are
compared from the root down, only below nodes that differ, and only the buckets
of leaves that differ are read and joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.operators.checkpoints import table_delta
from shardloom.operators.packed import FILE_BYTES, read_packed, write_packed
from shardloom.session import small

BUCKET = "__bucket"
TREE = "_tree"
BUCKET_ROWS = 10_000
MAX_BITS = 24
FANOUT_BITS = 8
WORDS = ["w1", "w2", "w3", "w4"]
LOW = 0xFFFFFFFF


def write_version(df: DataFrame, keys: Sequence[str], path: str, like: str | None = None, bits: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write ``df`` (unique ``keys``, nulls allowed) with its hash tree.

    There are 2^``bits`` buckets, by default of about ``BUCKET_ROWS`` rows; a
    version that is to be compared takes the number of the version ``like``.
    """
    spark, keys = df.sparkSession, list(keys)
    if like is not None:
        bits = stored_bits(spark, like)
    elif bits is None:
        bits = min(MAX_BITS, (df.count() // BUCKET_ROWS).bit_length())
    bucket = F.xxhash64(*_null_safe(df, keys)).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    write_packed(df.withColumn(BUCKET, bucket), path, BUCKET, keys, BUCKET_ROWS, file_bytes)
    _write_tree(spark.read.parquet(path), path, bits, file_bytes)


def stored_bits(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/{TREE}/root").first().bits


def _null_safe(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Columns to hash: the hash function passes over nulls, so each value comes with a mark."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name in names:
        value = F.col(f"`{name}`")
        out.append(value.isNull())
        nested = isinstance(kinds[name], (T.ArrayType, T.MapType, T.StructType))
        out.append(F.to_json(F.struct(value), {"ignoreNullFields": "false"}) if nested else value)
    return out


def _sums(*hashed: Column) -> list[Column]:
    """Two hashes summed in halves, which 2^31 rows cannot overflow."""
    words = []
    for salt in (1, 2):
        h = F.xxhash64(F.lit(salt), *hashed)
        words += [F.sum(h.bitwiseAND(F.lit(LOW).cast("long"))), F.sum(F.shiftrightunsigned(h, 32))]
    return [w.alias(name) for w, name in zip(words, WORDS)]


def levels_of(bits: int) -> list[int]:
    """Bits of the node numbers from the leaves up, without the root."""
    return list(range(bits, 0, -FANOUT_BITS))


def _write_tree(rows: DataFrame, path: str, bits: int, file_bytes: int) -> None:
    spark = rows.sparkSession
    values = _null_safe(rows, sorted(c for c in rows.columns if c != BUCKET))
    nodes = rows.groupBy(F.col(BUCKET).alias("node")).agg(F.count(F.lit(1)).alias("rows"), *_sums(*values))
    for level in levels_of(bits):
        place = f"{path}/{TREE}/{level}"
        parent = F.shiftright("node", FANOUT_BITS)
        write_packed(nodes.withColumn("parent", parent), place, "parent", ["node"], 1 << FANOUT_BITS, file_bytes)
        nodes = spark.read.parquet(place).groupBy(F.col("parent").alias("node")).agg(F.sum("rows").alias("rows"), *_sums(F.col("node"), F.col("rows"), *map(F.col, WORDS)))
    # The top holds one row, or none of an empty table.
    root = nodes.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *_sums(F.col("node"), F.col("rows"), *map(F.col, WORDS)))
    root.withColumn("bits", F.lit(bits)).coalesce(1).write.parquet(f"{path}/{TREE}/root")


def _differing(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of the nodes that are not the same on both sides."""
    told = F.struct("rows", *WORDS)
    a = base.select(F.col(key).alias("k"), told.alias("a"))
    b = new.select(F.col(key).alias("k"), told.alias("b"))
    return a.join(b, "k", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("k")


def changed_buckets(spark: SparkSession, base: str, new: str) -> DataFrame:
    """(__bucket) of the buckets whose rows differ between two stored versions."""
    roots = [spark.read.parquet(f"{p}/{TREE}/root") for p in (base, new)]
    bits = [r.first().bits for r in roots]
    if bits[0] != bits[1]:
        raise ValueError(f"the versions have 2^{bits[0]} and 2^{bits[1]} buckets: write the new one with like={base!r}")
    changed = small(_differing(*[r.withColumn("node", F.lit(0).cast("long")) for r in roots], "node"))
    for level in reversed(levels_of(bits[0])):
        parents = changed.withColumnRenamed("k", "parent")
        below = [read_packed(spark, f"{p}/{TREE}/{level}", parents, "parent") for p in (base, new)]
        changed = small(_differing(*below, "node"))
    return changed.withColumnRenamed("k", BUCKET)


def version_delta(spark: SparkSession, base: str, new: str, keys: Sequence[str]) -> DataFrame:
    """``table_delta`` between two stored versions, reading the changed buckets only."""
    kinds = [{f.name: f.dataType for f in spark.read.parquet(p).schema.fields} for p in (base, new)]
    if kinds[0] != kinds[1]:
        raise ValueError(f"the versions differ in their columns: {kinds[0]} and {kinds[1]}")
    buckets = changed_buckets(spark, base, new)
    old, fresh = (read_packed(spark, p, buckets, BUCKET).drop(BUCKET) for p in (base, new))
    return table_delta(old, fresh, keys)
