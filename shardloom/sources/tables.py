"""One loader for the declared dataset formats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from shardloom.sources.tfrecord import read_tfrecord
from shardloom.sources.webdataset import read_webdataset

# Declared format names and the Spark reader behind each.
READERS = {
    "parquet": "parquet",
    "csv": "csv",
    "json": "json",
    "jsonl": "json",
    "text": "text",
    "binary": "binaryFile",
}
# Formats read by this package.
OWN = ("tfrecord", "webdataset")


@dataclass(frozen=True)
class DatasetSpec:
    """Declaration of one dataset, as given at registration."""

    dataset_id: str
    path: str
    shard_size: int
    format: str = "parquet"
    shuffle: bool = False
    seed: int = 42
    schema: StructType | str | None = None


def load(spark: SparkSession, fmt: str, path: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """Read ``path`` in one of the declared formats; csv, json and tfrecord need a schema.

    A schema of fewer columns than a tfrecord file has decodes only those;
    ``extensions`` does the same for webdataset (see their modules for options).
    """
    if fmt not in READERS and fmt not in OWN:
        raise ValueError(f"unsupported format {fmt!r}; known: {', '.join([*READERS, *OWN])}")
    if fmt in ("csv", "json", "jsonl", "tfrecord") and schema is None:
        raise ValueError(f"{fmt} needs a schema; inferring one would read the data twice")
    if fmt == "tfrecord":
        own = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return read_tfrecord(spark, path, own, **options)
    if fmt == "webdataset":
        return read_webdataset(spark, path, **options)
    reader = spark.read.format(READERS[fmt])
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, "parquet", f"{sf_dir}/{name}.parquet")
