"""Checkpoint containers: binary files with a small header before the data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.binary import little_endian, read_little_endian
from shardloom.session import batches_of
from shardloom.sources.ranges import files, store

# The container format. Little endian: magic, version (4 bytes),
# step (8), epoch (8), type (1), compressed (1), data size (8), metadata length
# (4), metadata as JSON, data.
MAGIC = b"CKPT"
VERSION = 1
HEADER_BYTES = 38
BATCH_BYTES = 8 << 20  # of contents a Python task is handed at once
RECEIPT = pa.schema([("name", pa.string()), ("size_bytes", pa.int64())])


def header(step: Column, epoch: Column, kind: Column, metadata: Column, data_size: Column) -> Column:
    """All of a container before its data; ``kind`` is a type number."""
    notes = F.encode(F.to_json(metadata), "UTF-8")
    return F.concat(
        F.lit(MAGIC),
        little_endian(F.lit(VERSION), 4),
        little_endian(step, 8),
        little_endian(epoch, 8),
        little_endian(kind, 1),
        little_endian(F.lit(0), 1),
        little_endian(data_size, 8),
        little_endian(F.octet_length(notes), 4),
        notes,
    )


def container(step: Column, epoch: Column, kind: Column, metadata: Column, data: Column) -> Column:
    """One container as BINARY; ``data`` is BINARY."""
    return F.concat(header(step, epoch, kind, metadata, F.octet_length(data)), data)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme; without one it belongs to the session's default file system."""
    if "://" in path:
        return path
    files = spark._jvm.org.apache.hadoop.fs.FileSystem
    base = files.getDefaultUri(spark._jsc.hadoopConfiguration()).toString()
    return f"file://{path}" if base.startswith("file:") else base.rstrip("/") + path


def encode_checkpoint(df: DataFrame, path: str) -> DataFrame:
    """Write one file per row of (name, content) below ``path``; returns receipts.

    Tasks write in parallel to the shared folder. Each file is written under a
    temporary name and then moved, so a retried or duplicate task leaves a whole
    file. A task holds a few MB of contents, or one larger content. The receipts
    (name, size_bytes) are a table next to the files.
    """

    place = qualified(df.sparkSession, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(place)
        store.create_dir(f"{root}/data", recursive=True)
        for rows in batches:
            names, sizes = rows.column("name").to_pylist(), []
            for name, content in zip(names, rows.column("content")):
                partial = f"{root}/data/_{name}.{uuid.uuid4().hex}"
                held = content.as_buffer()
                with store.open_output_stream(partial) as out:
                    out.write(held)
                store.move(partial, f"{root}/data/{name}")
                sizes.append(held.size)
            rows = content = held = None  # else they stay while the next batch comes
            yield pa.RecordBatch.from_pydict({"name": names, "size_bytes": sizes}, schema=RECEIPT)

    receipts = df.select("name", "content").mapInArrow(write, "name string, size_bytes bigint")
    with batches_of(df.sparkSession, BATCH_BYTES):
        receipts.write.mode("errorifexists").parquet(f"{path}/receipts")
    return df.sparkSession.read.parquet(f"{path}/receipts")


def write_chunks(heads: DataFrame, chunks: DataFrame, path: str) -> DataFrame:
    """Write containers of any size below ``path`` from ordered chunks of their data; returns receipts.

    ``heads`` has (name, step, epoch, kind, metadata), one row per container, and
    ``chunks`` (name, chunk, data). A container is written by one task, chunk after
    chunk, so it holds a batch of chunks and never a whole file. Chunks are read
    twice, the first time for their sizes only; null data is empty, and a head
    without chunks gets a container without data.
    """
    place = qualified(heads.sparkSession, path)
    sizes = chunks.groupBy("name").agg(F.sum(F.octet_length("data").cast("bigint")).alias("size"))
    sized = heads.join(sizes, "name", "left")
    first = header(F.col("step"), F.col("epoch"), F.col("kind"), F.col("metadata"), F.coalesce("size", F.lit(0).cast("bigint")))
    body = chunks.join(heads.select("name"), "name", "left_semi").select("name", F.col("chunk").cast("bigint").alias("chunk"), "data")
    pieces = sized.select("name", F.lit(-1).cast("bigint").alias("chunk"), first.alias("data")).union(body)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(place)
        store.create_dir(f"{root}/data", recursive=True)
        at, out, partial, written = None, None, "", 0

        def close() -> pa.RecordBatch:
            out.close()
            store.move(partial, f"{root}/data/{at}")
            return pa.RecordBatch.from_pydict({"name": [at], "size_bytes": [written]}, schema=RECEIPT)

        for rows in batches:
            for name, data in zip(rows.column("name").to_pylist(), rows.column("data")):
                if name != at:
                    if out is not None:
                        yield close()
                    at, partial, written = name, f"{root}/data/_{name}.{uuid.uuid4().hex}", 0
                    out = store.open_output_stream(partial)
                if data.is_valid:
                    held = data.as_buffer()
                    out.write(held)
                    written += held.size
            rows = data = held = None  # else they stay while the next batch comes
        if out is not None:
            yield close()

    parts = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = pieces.repartition(parts, "name").sortWithinPartitions("name", "chunk")
    receipts = laid.mapInArrow(write, "name string, size_bytes bigint")
    with batches_of(heads.sparkSession, BATCH_BYTES):
        receipts.write.mode("errorifexists").parquet(f"{path}/receipts")
    return heads.sparkSession.read.parquet(f"{path}/receipts")


def scan_headers(spark: SparkSession, path: str) -> DataFrame:
    """Header fields of containers of any size and what is wrong with each; data is not read.

    A task reads the fixed part of a file and the metadata it announces, as far
    as the file goes.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _described(_headed(files(spark, f"{path}/data", "*").repartition(parts))).drop("path")


def _headed(listed: DataFrame) -> DataFrame:
    """(path, name, file_size, content): the bytes of each file up to its data."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            heads = []
            for path, length in zip(rows["path"], rows["length"]):
                system, inside = store(path)
                with system.open_input_file(inside) as file:
                    fixed = file.read_at(min(HEADER_BYTES, length), 0)
                    notes = int.from_bytes(fixed[34:38], "little") if len(fixed) == HEADER_BYTES and fixed[:4] == MAGIC else 0
                    heads.append(fixed + file.read_at(min(notes, length - len(fixed)), len(fixed)) if notes else fixed)
            yield pd.DataFrame({"path": rows["path"], "file_size": rows["length"], "content": heads})

    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return listed.mapInPandas(read, "path string, file_size bigint, content binary").select("path", name, "file_size", "content")


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(name, chunk, offset, data): the data of whole containers as byte ranges, read by many tasks.

    ``offset`` counts within the data. Files that are damaged or cut short have no
    chunks; ``scan_headers`` names them.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = _described(_headed(files(spark, f"{path}/data", "*").repartition(parts))).filter("not is_corrupt and size_ok and data_size > 0")
    count = F.ceil(F.col("data_size") / chunk_bytes).cast("bigint")
    numbered = whole.select("path", "name", "metadata_size", "data_size", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("chunk"))
    offset = F.col("chunk") * chunk_bytes
    ranges = numbered.select(
        "path", "name", "chunk", offset.alias("offset"), (HEADER_BYTES + F.col("metadata_size") + offset).alias("start"),
        F.least(F.lit(chunk_bytes).cast("bigint"), F.col("data_size") - offset).alias("size"),
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, name, chunk, offset, start, size in rows.itertuples(index=False):
                system, inside = store(path)
                with system.open_input_file(inside) as file:
                    yield pd.DataFrame({"name": [name], "chunk": [chunk], "offset": [offset], "data": [file.read_at(size, start)]})

    return ranges.repartition(parts, "name", "chunk").mapInPandas(read, "name string, chunk bigint, offset bigint, data binary")


def _described(files: DataFrame) -> DataFrame:
    """Header fields and faults of (name, file_size, content, ...); ``content`` holds the file at least up to its data."""
    content = F.col("content")
    headed = files.select(
        "*",
        (F.substring(content, 1, 4) != F.lit(MAGIC)).alias("wrong"),
        read_little_endian(content, 4, 4).alias("version"),
        read_little_endian(content, 8, 8).alias("step"),
        read_little_endian(content, 16, 8).alias("epoch"),
        read_little_endian(content, 24, 1).alias("type"),
        read_little_endian(content, 25, 1).alias("flag"),
        read_little_endian(content, 26, 8).alias("data_size"),
        read_little_endian(content, 34, 4).alias("metadata_size"),
    )
    notes = F.substring(content, F.lit(HEADER_BYTES + 1), F.col("metadata_size").cast("int"))
    # A missing or unreadable field means the file ends inside its header.
    broken = F.col("wrong") | F.col("metadata_size").isNull() | F.col("data_size").isNull()
    others = [c for c in files.columns if c not in ("name", "file_size", "content")]
    return headed.select(
        "name",
        "file_size",
        broken.alias("is_corrupt"),
        "version",
        F.coalesce(F.col("version") == VERSION, F.lit(False)).alias("version_ok"),
        "step",
        "epoch",
        "type",
        (F.col("flag") == 1).alias("compressed"),
        "data_size",
        "metadata_size",
        F.coalesce(F.col("file_size") >= HEADER_BYTES + F.col("metadata_size") + F.col("data_size"), F.lit(False)).alias("size_ok"),
        F.when(~broken, F.from_json(F.decode(notes, "UTF-8"), "map<string,string>")).alias("metadata"),
        *others,
    )


def scan_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Read containers up to 2 GB whole: header fields, data, and what is wrong with each file.

    ``scan_headers`` and ``read_chunks`` take containers of any size.
    """
    read = spark.read.format("binaryFile").load(f"{path}/data")
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    described = _described(read.select(name, F.col("length").alias("file_size"), "content", F.col("content").alias("whole")))
    body = HEADER_BYTES + F.col("metadata_size") + 1
    data = F.substring(F.col("whole"), body.cast("int"), F.col("data_size").cast("int"))
    return described.withColumn("data", F.when(~F.col("is_corrupt"), data)).drop("whole", "metadata_size")
