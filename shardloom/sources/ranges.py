"""Files as byte ranges that tasks read on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT_BYTES = 128 << 20


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length) of every file below ``path`` whose name fits; contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return listed.load(path).select("path", "length")


def file_ranges(spark: SparkSession, path: str, pattern: str, split_bytes: int | None = SPLIT_BYTES) -> DataFrame:
    """(path, length, start, end): ranges of at most ``split_bytes``, dealt to as many tasks; whole files without a size.

    A listing alone decides the number of tasks, so one huge file is read by many.
    """
    every = files(spark, path, pattern)
    step = F.col("length") + 1 if split_bytes is None else F.lit(split_bytes)
    pieces = F.greatest(F.ceil(F.col("length") / step), F.lit(1)).cast("int")
    tasks = every.agg(F.sum(pieces).alias("n")).first().n
    cut = every.select("path", "length", step.cast("bigint").alias("step"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    start = F.col("piece") * F.col("step")
    ranges = cut.select("path", "length", start.alias("start"), F.least(start + F.col("step"), F.col("length")).alias("end"))
    return ranges.repartition(max(1, tasks or 0))


def store(path: str):
    """(file system, path in it) for the path of a file as Spark lists it; runs in tasks."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)
