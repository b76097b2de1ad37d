"""Many shards per file: files sized by bytes, an index beside them, reads by statistics.

A folder per shard makes as many folders as shards. Here a file holds a run of
consecutive shards in order, its pages end where shards end, and the index tells
the file of each shard. A read opens only the files of its shards, and inside
them the shard column's statistics leave out all other pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.session import small

FILE_BYTES = 256 << 20
INDEX = "_index"  # the leading underscore hides it from reads of the data
MAX_IDS = 100_000  # ids of one read that are looked up on the driver
MAX_FILES = 10_000
MAX_RANGES = 1_000


def write_packed(
    df: DataFrame, path: str, by: str = "shard_id", order: Sequence[str] = ("sample_idx",), shard_rows: int = 1000, file_bytes: int = FILE_BYTES
) -> None:
    """Write ``df`` by runs of ``by`` (integers from 0, none null), and the index of its files.

    ``file_bytes`` counts values before compression and sets the number of files;
    ``shard_rows`` is the usual size of a shard, where pages end. One pass measures
    the rows, so ``df`` should come from files. No shard spans two files: a shard
    above ``file_bytes`` makes a file as large as itself. An empty table is one
    file without rows.
    """
    size = df.agg(F.sum(_row_bytes(df)).alias("bytes"), (F.max(by) + 1).alias("shards")).first()
    shards = size.shards or 1
    files = min(shards, max(1, -(-(size.bytes or 0) // file_bytes)))
    per_file = -(-shards // files)
    files = -(-shards // per_file)
    placed = df.repartitionById(files, F.floor(F.col(by) / per_file).cast("int")).sortWithinPartitions(by, *order)
    paged = placed.write.mode("errorifexists").option("parquet.page.row.count.limit", shard_rows)
    paged.parquet(path)
    _write_index(df.sparkSession, path, by)


def _row_bytes(df: DataFrame) -> Column:
    """The bytes of a row's values: texts by length, nested values as JSON, others 8."""
    total = F.lit(0).cast("long")
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(value).cast("long"), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.length(F.to_json(F.struct(value))).cast("long"), F.lit(0))
        else:
            total = total + F.lit(8)
    return total


def _write_index(spark: SparkSession, path: str, by: str) -> None:
    rows = spark.read.parquet(path).select(F.col(by).alias("id"), F.col("_metadata.file_name").alias("file"))
    found = rows.groupBy("id", "file").agg(F.count(F.lit(1)).alias("num_rows"))
    # A few numbers per shard; sorted, so that a lookup of few ids reads few pages.
    found.sort("id").write.parquet(f"{path}/{INDEX}")


def packed_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, file, num_rows) of every written shard."""
    return spark.read.parquet(f"{path}/{INDEX}")


def read_packed(spark: SparkSession, path: str, ids: DataFrame, by: str = "shard_id") -> DataFrame:
    """The rows of the shards in ``ids`` (one column ``by``; repeats and unknown ids count for nothing).

    Up to ``MAX_IDS`` ids choose the files and become ranges in the filter; with
    more than ``MAX_RANGES`` ranges the nearest are joined, and with more ids all
    files are read. The join with ``ids`` decides in any case.
    """
    wanted = small(ids.select(by).distinct(), MAX_IDS)
    rows = spark.read.parquet(path)
    if getattr(wanted, "pinned_rows", None) is not None:
        found = packed_index(spark, path).join(wanted, F.col("id") == F.col(by)).select("id", "file").collect()
        files = sorted({r.file for r in found})
        if len(files) <= MAX_FILES:
            rows = spark.read.schema(rows.schema).parquet(*[f"{path}/{f}" for f in files]) if files else rows.filter(F.lit(False))
        if found:
            rows = rows.filter(_within(by, sorted({r.id for r in found})))
    return rows.join(wanted, by, "left_semi")


def id_ranges(ids: Sequence[int], most: int = MAX_RANGES) -> list[tuple[int, int]]:
    """The runs of ascending ``ids``; beyond ``most``, runs over the smallest gaps are joined."""
    gaps = [(b - a, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if b - a > 1]
    cuts = sorted(i for _, i in sorted(gaps, reverse=True)[: most - 1])
    starts = [0, *[i + 1 for i in cuts]]
    ends = [*cuts, len(ids) - 1]
    return [(ids[a], ids[b]) for a, b in zip(starts, ends)]


def _within(by: str, ids: Sequence[int]) -> Column:
    """Ranges joined by OR in a balanced tree: unlike a long IN list they all reach the file's statistics."""
    tests = [F.col(by) == a if a == b else F.col(by).between(a, b) for a, b in id_ranges(ids)]
    while len(tests) > 1:
        pairs = [a | b for a, b in zip(tests[::2], tests[1::2])]
        tests = pairs + tests[len(pairs) * 2 :]
    return tests[0]


def read_packed_shard(spark: SparkSession, path: str, assignment: DataFrame, worker_id: str, epoch: int) -> DataFrame:
    """The rows of one worker's shards in one epoch with their place in its order."""
    own = assignment.filter((F.col("worker_id") == worker_id) & (F.col("epoch") == epoch))
    own = small(own.select("shard_id", "worker_id", "epoch", "order_index"), MAX_IDS)
    return read_packed(spark, path, own.select("shard_id")).join(own, "shard_id")
