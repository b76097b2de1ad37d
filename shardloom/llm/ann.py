"""Approximate nearest neighbours: an NN-descent graph and greedy search on it.

The graph starts from the nearest of random groups. Each round brings together,
at every vector, the vectors that its edges name in either direction, compares
those of which an edge is new, and offers each its nearest company; lists keep
the best. Rounds end when few edges change. A search keeps the best nodes found
for a query, follows the edges of those not yet followed, all queries at once,
and ends when none of the best is left to follow.

Equal vectors are one node that knows its smallest ids, as many as any answer
can need, so copies neither fill the lists nor cut the graph. Graph and search
use half precision; answers are measured in double precision on the originals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.llm.common import read, settle, small_batches
from shardloom.llm.subspace import usable

NEIGHBOURS = 10
EDGES = 24
OFFERS = 4
BEAM = 128
GROUP = 128
STARTS = 2
STILL = 0.02
MAX_ROUNDS = 12
ENTRIES = 64
TOGETHER = 1024
ROW = "__row"


def _stack(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float32)


def _company(offers: int):
    """Rows by centre to (u, w, d): for each member the nearest others at its centres, nearer than its worst edge."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        center = rows["center"].to_numpy()
        node, fresh, worst = rows["node"].to_numpy(), rows["fresh"].to_numpy(), rows["worst"].to_numpy()
        vectors = _stack(rows["half"], np.float16)
        square = (vectors * vectors).sum(1)
        heads = np.flatnonzero(np.concatenate([[True], center[1:] != center[:-1]]))
        us, ws, ds = [], [], []
        for a, b in zip(heads, np.append(heads[1:], len(center))):
            if b - a < 2 or not fresh[a:b].any():
                continue
            for low in range(a, b, TOGETHER):
                high = min(b, low + TOGETHER)
                apart = np.maximum(square[low:high, None] + square[None, a:b] - 2 * (vectors[low:high] @ vectors[a:b].T), 0)
                bad = ~(fresh[low:high, None] | fresh[None, a:b]) | (node[low:high, None] == node[None, a:b])
                apart[bad | (apart >= worst[low:high, None])] = np.inf
                k = min(offers, b - a - 1)
                best = np.argpartition(apart, k - 1, axis=1)[:, :k]
                d = np.take_along_axis(apart, best, 1)
                i, j = np.nonzero(np.isfinite(d))
                us.append(node[low:high][i])
                ws.append(node[a:b][best[i, j]])
                ds.append(d[i, j])
        if not us:
            return pd.DataFrame({"u": np.empty(0, np.int64), "w": np.empty(0, np.int64), "d": np.empty(0, np.float32)})
        out = pd.DataFrame({"u": np.concatenate(us), "w": np.concatenate(ws), "d": np.concatenate(ds)})
        return out.drop_duplicates(["u", "w"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for rows in batches:
            if rest is not None:
                rows = pd.concat([rest, rows], ignore_index=True)
            last = rows["center"].iloc[-1]
            rest = rows[rows["center"] == last]
            if len(rest) < len(rows):
                yield join(rows[rows["center"] != last])
        if rest is not None and len(rest):
            yield join(rest)

    return run


def _best(edges: int):
    """Rows sorted by (u, w, fresh) to the nearest distinct w of each u."""

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["u", "w"]).sort_values(["u", "d", "w"], kind="stable")
        return rows[rows.groupby("u", sort=False).cumcount() < edges]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for rows in batches:
            if rest is not None:
                rows = pd.concat([rest, rows], ignore_index=True)
            last = rows["u"].iloc[-1]
            rest = rows[rows["u"] == last]
            if len(rest) < len(rows):
                yield keep(rows[rows["u"] != last])
        if rest is not None and len(rest):
            yield keep(rest)

    return run


def _merge(edges: DataFrame, count: int) -> DataFrame:
    sorted_edges = edges.repartition("u").sortWithinPartitions("u", "w", "fresh")
    return sorted_edges.mapInPandas(_best(count), "u long, w long, d float, fresh boolean")


def descend(points: DataFrame, edges: int = EDGES, offers: int = OFFERS) -> DataFrame:
    """The neighbour graph (u, w, d: squared distance of the halves) of ``points`` (node, half)."""
    joined = "u long, w long, d float"
    total = points.count()
    groups = max(1, total // GROUP)
    start = None
    for r in range(STARTS):
        rows = points.select(
            F.pmod(F.xxhash64("node", F.lit(r)), F.lit(groups)).alias("center"), "node", F.lit(True).alias("fresh"), F.lit(float("inf")).cast("float").alias("worst"), "half"
        )
        found = rows.repartition("center").sortWithinPartitions("center").mapInPandas(_company(edges), joined)
        start = found if start is None else start.union(found)
    graph = settle(_merge(start.withColumn("fresh", F.lit(True)), edges), "graph")
    for turn in range(MAX_ROUNDS):
        worst = graph.groupBy("u").agg(F.when(F.count("*") >= edges, F.max("d")).otherwise(float("inf")).cast("float").alias("worst"))
        members = points.join(worst.withColumnRenamed("u", "node"), "node")
        # Back edges are sampled anew each round, as the method has it: a hub has no end of them.
        chance = Window.partitionBy("w").orderBy(F.desc("fresh"), F.xxhash64("u", F.lit(turn)))
        back = graph.withColumn("r", F.row_number().over(chance)).filter(F.col("r") <= edges).select("w", "u", "fresh")
        both = graph.select(F.col("u").alias("center"), F.col("w").alias("node"), "fresh").union(back)
        once = both.groupBy("center", "node").agg(F.max("fresh").alias("fresh"))
        met = once.join(members, "node").select("center", "node", "fresh", "worst", "half")
        found = met.repartition("center").sortWithinPartitions("center").mapInPandas(_company(offers), joined)
        offered = graph.withColumn("fresh", F.lit(False)).union(found.withColumn("fresh", F.lit(True)))
        graph = settle(_merge(offered, edges), "graph")
        if graph.filter("fresh").count() <= STILL * total * edges:
            break
    return graph


def _distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        if len(rows):
            gap = _stack(rows["half"], np.float16) - _stack(rows["asked"], np.float16)
            yield pd.DataFrame({"q": rows["q"], "node": rows["node"], "d": (gap * gap).sum(1)})


def search(graph: DataFrame, points: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """(q, node): the ``beam`` best nodes that greedy search finds for ``queries`` (q, asked, start).

    ``start`` is a node to begin at, or null for the entry points, some nodes of
    small hash.
    """
    out_and_in = settle(graph.select("u", "w").union(graph.select("w", "u")).distinct().toDF("node", "next"), "adjacent")
    asked = queries.select("q", "asked")
    entries = points.select("node").orderBy(F.xxhash64("node")).limit(ENTRIES)
    named = queries.filter("start is not null").select("q", F.col("start").alias("node"))
    guided = queries.filter("start is null").select("q").join(F.broadcast(entries))
    measured = "q long, node long, d float"

    def measure(pairs: DataFrame) -> DataFrame:
        return pairs.join(points.select("node", "half"), "node").join(asked, "q").select("q", "node", "half", "asked").mapInPandas(_distances, measured)

    best = Window.partitionBy("q").orderBy("d", "node")
    state = settle(measure(named.union(guided)).withColumn("followed", F.lit(False)), "beam")
    while not (front := state.filter("not followed")).isEmpty():
        reached = front.select("q", "node").join(out_and_in, "node").select("q", F.col("next").alias("node")).distinct()
        known = state.select("q", "node", "d").withColumn("followed", F.lit(True))
        every = known.union(measure(reached).withColumn("followed", F.lit(False)))
        merged = every.groupBy("q", "node").agg(F.min("d").alias("d"), F.max("followed").alias("followed"))
        state = settle(merged.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= beam).drop("r"), "beam")
    return state.select("q", "node")


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        if len(rows):
            a, b = (np.frombuffer(b"".join(rows[c]), np.float64).reshape(len(rows), -1) for c in ("raw", "mine"))
            gap = a - b
            size = np.abs(gap).max(1, keepdims=True)
            scaled = np.divide(gap, size, out=np.zeros_like(gap), where=size > 0)
            score = np.where((size[:, 0] > 1e-150) & (size[:, 0] < 1e150), np.sqrt((gap * gap).sum(1)), size[:, 0] * np.sqrt((scaled * scaled).sum(1)))
            yield pd.DataFrame({"q": rows["q"], "node": rows["node"], "score": score})


def _halves(scale: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            raw = [np.asarray(x, np.float64) for x in rows["vector"]]
            yield pd.DataFrame({"node": rows["node"], "half": [(x / scale).astype(np.float16).tobytes() for x in raw], "raw": [x.tobytes() for x in raw]})

    return run


def nearest(rows: DataFrame, asks, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows that ``asks`` (a condition on ``key``) picks, among all rows.

    Euclidean distance, nearest first, ties to the smaller key; a row is no
    candidate of its own. Null, zero and non-finite vectors, vectors of another
    length than most, and rows with a null key take no part. Rows equal in key
    and vector are one; a repeated key with other vectors is asked once per vector.
    """
    small_batches(rows.sparkSession)
    named = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")).filter(usable(F.col("vector")) & F.col("key").isNotNull()).distinct()
    usual = named.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return rows.sparkSession.createDataFrame([], schema.replace("vec_id", key))
    named = named.filter(F.size("vector") == usual.n).withColumn("node", F.xxhash64("vector"))
    named = settle(named, "vectors")
    largest = named.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x).cast("double"))))).first()[0]
    classes = named.groupBy("node").agg(F.first("vector").alias("vector"))
    points = settle(classes.mapInPandas(_halves(largest), "node long, half binary, raw binary"), "points")
    graph = descend(points.select("node", "half"))
    # A class answers with its k + 1 smallest ids: one may be the query's own.
    small = Window.partitionBy("node").orderBy("key")
    spread = Window.partitionBy("node", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy("key")
    ids = named.select("node", "key").withColumn("r", F.row_number().over(spread)).filter(F.col("r") <= k + 1)
    ids = settle(ids.withColumn("r", F.row_number().over(small)).filter(F.col("r") <= k + 1).drop("r"), "ids")
    asking = settle(named.filter(asks(F.col("key"))).select(F.col("key").alias("query_id"), F.col("node").alias("q")).distinct(), "asking")
    distinct = asking.select("q").distinct().join(points.select(F.col("node").alias("q"), F.col("half").alias("asked"), F.col("raw").alias("mine")), "q")
    found = search(graph, points, distinct.select("q", "asked", F.col("q").alias("start")), max(BEAM, 2 * k + 2))
    measured = found.join(points.select("node", "raw"), "node").join(distinct.select("q", "mine"), "q").mapInPandas(_exact, "q long, node long, score double")
    named_hits = measured.join(ids, "node").join(asking, "q").filter("key <> query_id")
    order = Window.partitionBy("query_id", "q").orderBy("score", "key")
    out = named_hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("key").alias(key), "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), lambda key: key % 100 == 0)
