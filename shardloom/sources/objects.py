"""Inventory of stored files and its comparison with the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def object_inventory(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Files below ``root`` whose relative path starts with ``prefix``, sorted.

    Only file metadata is used; the reader prunes the content column.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://")[-1].split(":", 1)[-1].rstrip("/") + "/"
    relative = F.substring_index("path", base, -1)
    listed = files.select(
        relative.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")
    )
    return listed.filter(F.col("path").startswith(prefix)).orderBy("path")


def catalogue_vs_files(catalogue: DataFrame, inventory: DataFrame) -> DataFrame:
    """Catalogue paths without a file, and files without a catalogue entry."""
    entries, files = catalogue.select("path"), inventory.select("path")
    missing = entries.join(files, "path", "left_anti").withColumn("finding", F.lit("missing_file"))
    orphans = files.join(entries, "path", "left_anti").withColumn("finding", F.lit("orphan_file"))
    return missing.unionByName(orphans)
