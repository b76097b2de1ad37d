"""Sources, sinks and triggers shared by the streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Merge sessions inside each task first, so a hot key shuffles few rows.
LOCAL_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def prepare(spark: SparkSession) -> None:
    """Settings the streaming queries need, where the session has none of its own."""
    for key, value in ((STATE_STORE, ROCKSDB), (LOCAL_SESSIONS, "true")):
        if not spark.conf.get(key, None) or key == LOCAL_SESSIONS:
            spark.conf.set(key, value)


def file_stream(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files appearing in ``folder``; the trigger limit is the back-pressure."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermark on a zone-free time column, which must become TIMESTAMP first."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def run_batches(stream: DataFrame, mode: str, folder: str, write: Callable[[DataFrame, int], None]) -> None:
    """Process everything available now, batch by batch, and wait for the end."""
    started = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/progress")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()


def run_available_now(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run to the end and read back the output rows, with the batch they came from.

    Each batch overwrites its own folder, so a repeated batch leaves one copy.
    """
    prepare(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run_batches(stream, mode, folder, write)
    return stream.sparkSession.read.schema(stream.schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out/batch=*")


def newest_state(updates: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Collapse update-mode output to the last row per key, by a growing column."""
    others = [c for c in updates.columns if c not in keys]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(at)).alias("r"))
    return last.select(*keys, "r.*")


def table_version(spark: SparkSession, folder: str, name: str, number: int) -> DataFrame | None:
    """A table written by batch ``number``, or None before the first batch."""
    return spark.read.parquet(f"{folder}/{name}/batch={number}") if number >= 0 else None
