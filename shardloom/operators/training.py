"""Training metrics over steps, batches and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.operators.ordered import ordered
from shardloom.operators.workers import seconds_between


def numbered_steps(log: DataFrame, slices: int | None = None) -> DataFrame:
    """Number the steps of each run from 0 by time."""
    return ordered(log, ["run"], ["ts", "event_id"], position="step", slices=slices)


def epoch_metrics(steps: DataFrame, steps_per_epoch: int) -> DataFrame:
    """Mean batch loss and accuracy in percent per run and epoch."""
    epoch = F.floor(F.col("step") / steps_per_epoch).cast("bigint")
    return steps.groupBy("run", epoch.alias("epoch")).agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("loss").alias("loss_sum"),
        F.sum("correct").alias("correct"),
    ).select(
        "run",
        "epoch",
        "batches",
        (F.col("loss_sum").cast("double") / F.col("batches")).alias("mean_loss"),
        (F.col("correct") * 100 / F.col("batches")).alias("accuracy"),
    )


def windowed_loss(steps: DataFrame, block: int = 100, slices: int | None = None) -> DataFrame:
    """Mean loss of each full block of batches; the accuracy is cumulative.

    Steps shrink to one row per block first; only blocks are accumulated.
    """
    number = F.floor(F.col("step") / block).cast("bigint")
    blocks = steps.groupBy("run", number.alias("block")).agg(
        F.count(F.lit(1)).alias("batches"), F.sum("loss").alias("loss_sum"), F.sum("correct").alias("correct")
    )
    running = ordered(
        blocks, ["run"], ["block"], sums={"seen": "batches", "right": "correct"}, slices=slices
    )
    return running.filter(F.col("batches") == block).select(
        "run",
        ((F.col("block") + 1) * block).alias("batch"),
        (F.col("loss_sum").cast("double") / block).alias("mean_loss"),
        (F.col("right") * 100 / F.col("seen")).alias("accuracy"),
    )


def argmax(scores: str):
    """Place of the first largest score, from 0."""
    return F.array_position(scores, F.array_max(scores)) - 1


def argmax_accuracy(df: DataFrame, scores: str, label: str, by=()) -> DataFrame:
    """Share of rows, in percent, whose largest score is at the label."""
    hit = df.withColumn("__hit", (argmax(scores) == F.col(label)).cast("bigint"))
    return hit.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("__hit").alias("correct"),
        (F.sum("__hit") * 100 / F.count(F.lit(1))).alias("accuracy"),
    )


def final_metrics_rollup(metrics: DataFrame) -> DataFrame:
    """Last loss and accuracy per run, and a line with their averages."""
    last = F.max_by(F.struct("loss", "accuracy"), "epoch").alias("m")
    final = metrics.groupBy("run").agg(last).select(F.col("run").cast("string").alias("run"), "m.*")
    lines = final.rollup("run").agg(
        F.avg("loss").alias("loss"), F.avg("accuracy").alias("accuracy"), F.grouping("run").alias("footer")
    )
    name = F.when(F.col("footer") == 1, "Average").otherwise(F.col("run"))
    return lines.select(name.alias("run"), F.when(F.col("footer") == 0, F.col("loss")).alias("loss"), "accuracy")


def training_rate(steps: DataFrame, batch_size: int, total_steps: int, slices: int | None = None) -> DataFrame:
    """Steps and samples per second between reports, and seconds to the end."""
    linked = ordered(
        steps,
        ["run"],
        ["ts", "event_id"],
        previous={"ts_before": "ts", "step_before": "step"},
        slices=slices,
    )
    seconds = seconds_between(F.col("ts_before"), F.col("ts"))
    rate = F.try_divide((F.col("step") - F.col("step_before")).cast("double"), seconds)
    timed = linked.withColumn("steps_per_s", rate)
    left = F.greatest(F.lit(total_steps) - F.col("step"), F.lit(0))
    return timed.select(
        "run",
        "step",
        "steps_per_s",
        (F.col("steps_per_s") * batch_size).alias("samples_per_s"),
        F.try_divide(left.cast("double"), F.col("steps_per_s")).alias("eta_s"),
    )
