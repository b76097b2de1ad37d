"""Shared pieces: input tables, written intermediates, connected components."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.session import settled


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(key: str = "doc_id", text: str = "text") -> Column:
    """Tells rows apart that share a doc_id; rows equal in both are one document."""
    return F.xxhash64(F.col(key), F.col(text))


def whole(df: DataFrame) -> Column:
    """All columns as one struct: work columns beside it clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files.

    Iterations call this once a round. Spark drops the shuffle files of ended
    jobs only after the driver has collected its garbage, so that is asked for.
    """
    out = settled(df, f"llm-{name}")
    release(df.sparkSession)
    return out


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of fewer rows than Spark's default, as rows hold whole texts; a setting of one's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) == 10_000:
        spark.conf.set(name, str(rows))


def release(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forest(a: np.ndarray, b: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For edges between places of ``nodes``: per node the smallest node it hangs together with."""
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return nodes[label]


CONTRACT = 2_000_000  # edges a task gathers before it contracts them


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task as stars: every node on the smallest it hangs together with there."""
    held, many = [], 0

    def stars() -> np.ndarray:
        both = np.concatenate(held)
        names, at = np.unique(both, return_inverse=True)
        at = at.reshape(-1, 2)
        root = forest(at[:, 0], at[:, 1], names)
        return np.stack([names, root], 1)[names != root]

    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy() for k in range(2)], 1))
        many += len(batch)
        if many > CONTRACT:
            held = [stars()]
            many = len(held[0])
            if many > CONTRACT // 2:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][:, 0]), pa.array(held[0][:, 1])], ["u", "v"])
                held, many = [], 0
    if many:
        out = stars()
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["u", "v"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b: bigint); smallest node of each component.

    Each task contracts its edges to stars. In every round all edges of a node
    meet in one task, which hangs its neighbours, and what else hangs together
    there, on the smallest of them, until every edge leads to a root. Edges stay
    distributed and a task hands on one edge for each node it has seen. Self
    loops and repeated edges are allowed.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    pairs = settle(pairs.mapInArrow(_contracted, "u long, v long").distinct(), "edges")
    for _ in range(max_rounds):
        ends = pairs.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
        ends = ends.union(pairs.select("v", F.lit(0), F.lit(1)))
        odd = ends.groupBy("n").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        if odd.filter("child > 1 or (child = 1 and parent = 1)").isEmpty():
            break
        both = pairs.union(pairs.select("v", "u")).repartition("u")
        pairs = settle(both.mapInArrow(_contracted, "u long, v long").distinct(), "stars")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(pairs.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )
