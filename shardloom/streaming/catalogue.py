"""The checkpoint catalogue kept up to date from a stream, and late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.operators.checkpoints import KEEP_COUNT, NOTIFIED, checkpoint_catalogue, retain_checkpoints
from shardloom.operators.ordered import ordered
from shardloom.streaming.run import run_batches, table_version


def merged_catalogue(before: DataFrame | None, notices: DataFrame) -> DataFrame:
    """The catalogue after one more batch of notifications."""
    fresh = checkpoint_catalogue(notices)
    if before is None:
        return fresh
    both = before.unionByName(fresh)
    others = [c for c in fresh.columns if c not in ("step", "overwritten")]
    newest = F.max_by(F.struct(*others), F.struct(*NOTIFIED)).alias("c")
    merged = both.groupBy("step").agg(newest, (F.sum(F.col("overwritten") + 1) - 1).alias("overwritten"))
    return merged.select("step", "c.*", "overwritten").select(*fresh.columns)


def stream_checkpoint_catalogue(notices: DataFrame, folder: str, keep: int = KEEP_COUNT) -> tuple[DataFrame, DataFrame]:
    """Run the stream to its end; gives the full catalogue and the kept entries.

    Every batch writes the next version of the catalogue from the one before, so
    repeating a batch changes nothing.
    """
    spark = notices.sparkSession
    versions = []

    def write(batch: DataFrame, number: int) -> None:
        merged = merged_catalogue(table_version(spark, folder, "catalogue", number - 1), batch)
        merged.write.mode("overwrite").parquet(f"{folder}/catalogue/batch={number}")
        versions.append(number)

    run_batches(notices, "append", folder, write)
    if not versions:
        raise ValueError("the stream had no input")
    catalogue = table_version(spark, folder, "catalogue", max(versions))
    return catalogue, retain_checkpoints(catalogue, keep)


def late_events(events: DataFrame, batch: str, delay_s: float) -> DataFrame:
    """Rows a stream would drop, for rows that carry the number of their batch.

    The watermark of a batch is the latest time of all earlier batches less the
    delay; a row is late when it is older than that.
    """
    tops = events.groupBy(batch).agg(F.max("ts").alias("top"))
    marks = ordered(tops, [], [batch], max_before={"seen": "top"})
    behind = F.col("seen") - F.make_dt_interval(secs=F.lit(delay_s).cast("decimal(18,6)"))
    marked = events.join(marks.select(batch, behind.alias("watermark")), batch)
    return marked.filter(F.col("ts") < F.col("watermark"))
