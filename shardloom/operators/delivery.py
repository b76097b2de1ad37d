"""From plans to rows: index, shard, shuffle, split and deliver samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.hashing import shuffle_key
from shardloom.operators.ordered import ordered
from shardloom.session import small

MAX_PLAN_ROWS = 1_000_000
MAX_PRUNED = 10_000


def index_samples(df: DataFrame, order_by: Sequence[str], out: str = "sample_idx", slices: int | None = None) -> DataFrame:
    """Add the dense position 0 .. N-1 of each row along a unique order."""
    return ordered(df, [], order_by, position=out, slices=slices)


def shard_samples(df: DataFrame, order_by: Sequence[str], shard_size: int, slices: int | None = None) -> DataFrame:
    """Add ``sample_idx`` and the ``shard_id`` it falls into."""
    indexed = index_samples(df, order_by, slices=slices)
    return indexed.withColumn("shard_id", F.floor(F.col("sample_idx") / shard_size).cast("bigint"))


def epoch_samples(samples: DataFrame, assignment: DataFrame) -> DataFrame:
    """The rows of each worker in each epoch, placed by shard order.

    ``assignment`` belongs to the dataset of ``samples``. A plan of checked size
    is broadcast; a larger one joins on the shard, which no key can skew, since
    a shard never exceeds its fixed size.
    """
    plan = small(assignment.select("shard_id", "worker_id", "epoch", "order_index"), MAX_PLAN_ROWS)
    return samples.join(plan, "shard_id")


def deliver(epoch_rows: DataFrame) -> DataFrame:
    """Lay rows out in reading order, range-split so a hot worker spans many tasks."""
    order = ["epoch", "worker_id", "order_index", "sample_idx"]
    return epoch_rows.repartitionByRange(*order).sortWithinPartitions(*order)


def shuffle_samples(df: DataFrame, id_col: str, *, dataset: str, epoch: int = 0, seed: int = 42, out: str = "position") -> DataFrame:
    """Reproducible row shuffle: the place of each row in the order of its key.

    MD5 keys spread evenly, so the ranges that split them do too.
    """
    key = shuffle_key(F.lit(seed), F.lit(dataset), F.lit(epoch), F.col(id_col))
    keyed = df.withColumn("shuffle_key", key)
    return ordered(keyed, [], ["shuffle_key", id_col], position=out).drop("shuffle_key")


def contiguous_split(df: DataFrame, order_by: Sequence[str], world: int) -> DataFrame:
    """Equal consecutive blocks per rank; the remainder of N / world is left out."""
    indexed = index_samples(df, order_by)
    block = F.floor(df.agg(F.count(F.lit(1))).scalar() / world).cast("bigint")
    rank = F.floor(F.try_divide(F.col("sample_idx"), block)).cast("bigint")
    return indexed.withColumn("rank", rank).filter(F.col("rank") < world)


def train_test_split(df: DataFrame, order_by: Sequence[str], train_percent: int = 80) -> DataFrame:
    """The first ``train_percent`` of the rows train, the rest test, by position."""
    total = df.agg(F.count(F.lit(1))).scalar()
    first_test = F.floor(total * train_percent / 100).cast("bigint")
    part = F.when(F.col("sample_idx") < first_test, "train").otherwise("test")
    return index_samples(df, order_by).withColumn("split", part)


def mini_batches(df: DataFrame, position: str, batch_size: int) -> DataFrame:
    """Add the batch number; the last batch keeps its few rows."""
    return df.withColumn("batch", F.floor(F.col(position) / batch_size).cast("bigint"))


def batch_summary(batched: DataFrame, batch_size: int) -> DataFrame:
    """One row: batches with the partial one, and the whole steps per epoch."""
    sizes = batched.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.agg(
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("batches"),
        F.floor(F.sum("rows") / batch_size).cast("bigint").alias("steps_per_epoch"),
        F.min_by("rows", "rows").alias("smallest_batch"),
        F.max("rows").alias("largest_batch"),
    )


def label_shift(df: DataFrame, features: str, label: str) -> DataFrame:
    """Shift every feature by (label - 5) * 0.5."""
    shift = (F.col(label).cast("double") - 5) * 0.5
    return df.withColumn(features, F.transform(features, lambda x: x.cast("double") + shift))


def normalize_features(df: DataFrame, features: str) -> DataFrame:
    """(x - mean) / standard deviation per dimension; a constant one becomes 0."""
    stats = (
        df.select(F.posexplode(features).alias("dim", "x"))
        .groupBy("dim")
        .agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))
    )
    # One entry per dimension: a few numbers, carried as a scalar subquery.
    table = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std")))).scalar()

    def scaled(x: Column, s: Column) -> Column:
        return F.coalesce(F.try_divide(x.cast("double") - s["mean"], s["std"]), F.lit(0.0))

    with_stats = df.withColumn("__stats", table)
    return with_stats.withColumn(features, F.zip_with(features, "__stats", scaled)).drop("__stats")


def per_worker_dataset(workers: DataFrame, choices: DataFrame, default: str) -> DataFrame:
    """Attach each worker's own dataset, or the default."""
    picked = workers.join(small(choices.select("worker_id", "dataset_id")), "worker_id", "left")
    return picked.withColumn("dataset_id", F.coalesce("dataset_id", F.lit(default)))


def preview(delivered: DataFrame, shard_size: int, per_shard: int) -> DataFrame:
    """The first rows of every shard, found by arithmetic on the sample index."""
    return delivered.filter(F.col("sample_idx") - F.col("shard_id") * shard_size < per_shard)


def write_sharded(df: DataFrame, path: str) -> None:
    """One folder and file per shard; a shard's fixed size bounds every task.

    The number of tasks is given, as files cost more here than bytes do, by which
    Spark would merge the tasks to fewer and uneven ones.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, "shard_id").write.mode("errorifexists").partitionBy("shard_id").parquet(path)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows and files of every written shard."""
    rows = spark.read.parquet(path).select(F.col("shard_id").cast("bigint").alias("shard_id"), F.input_file_name().alias("file"))
    return rows.groupBy("shard_id").agg(F.count(F.lit(1)).alias("num_samples"), F.collect_set("file").alias("file_paths"))


def read_shard(spark: SparkSession, path: str, assignment: DataFrame, worker_id: str, epoch: int) -> DataFrame:
    """Only the files of one worker's shards in one epoch.

    Of up to ``MAX_PRUNED`` shards only the own folders are listed. Where one of
    them is missing all are listed, and the ids are a filter on the folders; a
    longer list leaves the pruning to the join with the filtered plan.
    """
    own = assignment.filter((F.col("worker_id") == worker_id) & (F.col("epoch") == epoch))
    own = small(own.select("shard_id", "worker_id", "epoch", "order_index"), MAX_PLAN_ROWS)
    ids = sorted({r.shard_id for r in own.select("shard_id").limit(MAX_PRUNED + 1).collect()})
    if len(ids) > MAX_PRUNED:
        return spark.read.parquet(path).join(own, "shard_id")
    return _shards(spark, path, ids).filter(F.col("shard_id").isin(ids)).join(own, "shard_id")


def _shards(spark: SparkSession, path: str, ids: Sequence[int]) -> DataFrame:
    """A sharded table of the folders of ``ids``, or of all if one of those is missing."""
    if ids:
        try:
            return spark.read.option("basePath", path).parquet(*[f"{path}/shard_id={i}" for i in ids])
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.read.parquet(path)
