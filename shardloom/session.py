"""Session helpers: the shared work folder and size-checked small tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SMALL_ROWS = 100_000

_local_roots: dict[str, str] = {}  # of local sessions without a folder of their own


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run below the shared folder of the cluster.

    The shared folder is ``spark.checkpoint.dir``. Only a local session without
    that setting gets a temporary folder; a cluster without it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="shardloom-")
        root = _local_roots[app]
    return f"{root.rstrip('/')}/shardloom/{name}-{uuid.uuid4().hex}"


@contextmanager
def batches_of(spark: SparkSession, max_bytes: int) -> Iterator[None]:
    """Python tasks of jobs that start in here get batches of about ``max_bytes``, if the session allows larger ones.

    Spark's own bounds count rows, or bytes many times a worker's other memory.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) > max_bytes:
        spark.conf.set(name, f"{max_bytes}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small(df: DataFrame, max_rows: int = MAX_SMALL_ROWS) -> DataFrame:
    """Evaluate a planning table once and mark it for broadcast, if it is small.

    At most ``max_rows + 1`` rows reach the driver. A larger table comes back
    unchanged and without a hint, so joins with it shuffle.
    """
    if getattr(df, "pinned_rows", max_rows + 1) <= max_rows:
        return df
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    pinned = F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
    pinned.pinned_rows = rows.num_rows  # a second call has nothing left to do
    return pinned


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write a computed table to the shared folder and go on from the files.

    For inputs that several passes read: later passes and lost executors then
    re-read files instead of repeating the shuffles behind the table.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
