"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated at random and cut into blocks of few dimensions. Two
vectors of cosine c or more are at most 2 - 2c apart (squared), so in one block
at least they are within that block's share of it, in proportion to its
dimensions. Each block is range-joined on its own: a grid over its first
coordinates brings vectors in reach together, distances within the block pass
candidates, and these are verified exactly on the original vectors. A pair that
several blocks find counts in the first of them, so no list of pairs is needed.

Cells of any size meet part by part, each part pair in a task of its own. The
block distances say little about high-dimensional noise without structure; the
work then grows with the square of the vectors, in matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import components, forest, read, settle, small_batches

COSINE = 0.9
BLOCKS = 4
GRID = 2
PART = 65_536
TILE = 1024
SLACK = 1e-5
ROW = "__row"


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def block_sizes(dims: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(start, end) of the blocks of a rotated vector."""
    cuts = np.linspace(0, dims, min(blocks, dims) + 1).astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows or vanishes."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _rotate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, copies, dims, raw, turned): the vector as it is and its unit vector rotated, the same for all later tasks."""
    turns: dict[int, np.ndarray] = {}
    for rows in batches:
        if rows.empty:
            continue
        sizes = rows["vector"].map(len)
        for dims, own in rows.groupby(sizes, sort=False):
            if dims not in turns:
                turns[dims] = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))[0]
            raw = np.stack(own["vector"].to_numpy())
            if raw.dtype != np.float32:
                raw = raw.astype(np.float64)
            turned = (unit(raw) @ turns[dims]).astype(np.float32)
            yield pd.DataFrame({"node": own["node"], "copies": own["copies"], "dims": dims, "raw": [x.tobytes() for x in raw], "turned": [x.tobytes() for x in turned]})


def _cells(cosine: float):
    """(node, cell, home) for the home cell of each vector in each block, and the lower cells within reach."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for dims, own in rows.groupby("dims", sort=False):
                turned = np.frombuffer(b"".join(own["turned"]), np.float32).reshape(-1, dims).astype(np.float64)
                node = own["node"].to_numpy()
                out = []
                for number, (a, b) in enumerate(block_sizes(dims)):
                    reach = np.sqrt((2 - 2 * cosine) * (b - a) / dims) * (1 + SLACK) + SLACK
                    grid = turned[:, a : min(b, a + GRID)]
                    home = np.floor(grid / (2 * reach)).astype(np.int64)
                    low, high = (np.floor((grid + s * reach) / (2 * reach)).astype(np.int64) for s in (-1, 1))
                    shape = grid.shape[1]
                    for step in np.ndindex(*[3] * shape):
                        cell = home + np.array(step) - 1
                        inside = ((cell >= low) & (cell <= high)).all(1)
                        at_home = all(s == 1 for s in step)
                        # Two vectors of different homes meet in the lower one.
                        first = next((s for s in step if s != 1), 1)
                        if at_home or first < 1:
                            hit = np.flatnonzero(inside)
                            out.append(pd.DataFrame({"node": node[hit], "dims": dims, "number": number, "x": cell[hit, 0], "y": cell[hit, 1] if shape > 1 else 0, "home": at_home}))
                yield pd.concat(out, ignore_index=True)

    return run


def _pairs(cosine: float):
    """Per part pair of a cell: links of each vector and a forest of them."""

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        dims, number = int(rows["dims"].iloc[0]), int(rows["number"].iloc[0])
        node, copies, home, side = (rows[c].to_numpy() for c in ("node", "copies", "home", "side"))
        turned = np.frombuffer(b"".join(rows["turned"]), np.float32).reshape(-1, dims)
        raw = np.frombuffer(b"".join(rows["raw"]), np.float32 if len(rows["raw"].iloc[0]) == 4 * dims else np.float64).reshape(-1, dims)
        blocks = block_sizes(dims)
        budget = [(2 - 2 * cosine) * (b - a) / dims * (1 + SLACK) + SLACK for a, b in blocks]
        a, b = blocks[number]
        own = np.ascontiguousarray(turned[:, a:b])
        # |a|^2 - 2ab + |b|^2 as one product.
        square, ones = (own * own).sum(1, keepdims=True), np.ones((len(own), 1), np.float32)
        mine, theirs = np.hstack([own, square, ones]), np.hstack([-2 * own, ones, square])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        links = np.zeros(len(node), np.int64)
        found_i, found_j = [], []
        units = unit(raw)
        both = bool((side != 2).any())
        # Two vectors that only visit meet in a cell where one of them is at home.
        tiles = [(left[home[left]], right)]
        if both:
            tiles.append((left[~home[left]], right[home[right]]))
        bound = np.float32(budget[number] + SLACK)
        for one, two in ((a[p : p + TILE], b[q : q + TILE]) for a, b in tiles for p in range(0, len(a), TILE) for q in range(0, len(b), TILE)):
            close = mine[one] @ theirs[two].T <= bound
            if not close.any():
                continue
            i, j = np.nonzero(close)
            i, j = one[i], two[j]
            ok = node[i] != node[j]
            if not both:
                ok &= ~home[j] | (i < j)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            # The first block within its budget counts the pair; all tasks see the same numbers.
            ok = np.ones(len(i), bool)
            for k in range(number + 1):
                c, d = blocks[k]
                gap = turned[i, c:d].astype(np.float64) - turned[j, c:d].astype(np.float64)
                close = (gap * gap).sum(1) <= budget[k]
                ok &= close if k == number else ~close
            i, j = i[ok], j[ok]
            ok = (units[i] * units[j]).sum(1) >= cosine
            i, j = i[ok], j[ok]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            found_i.append(i)
            found_j.append(j)
        i = np.concatenate(found_i) if found_i else np.empty(0, int)
        j = np.concatenate(found_j) if found_j else np.empty(0, int)
        root = forest(i, j, node) if len(i) else node
        told = pd.DataFrame({"node": node, "links": links, "root": root})
        return told[told["links"] > 0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for rows in batches:
            if rest is not None:
                rows = pd.concat([rest, rows], ignore_index=True)
            last = rows["part"].iloc[-1]
            rest = rows[rows["part"] == last]
            for _, own in rows[rows["part"] != last].groupby("part", sort=False):
                yield part(own.sort_values("node", ignore_index=True))
        if rest is not None and len(rest):
            yield part(rest.sort_values("node", ignore_index=True))

    return run


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(``key``, n_links, component_id) for every distinct row.

    ``n_links`` counts other vectors of at least this cosine, ``component_id`` is
    the smallest key that links reach. Vectors that are null, zero, or hold null
    or non-finite components link with nothing, nor do vectors of different
    length. Rows equal in key and vector are one vector; keys that repeat with
    other vectors are vectors of their own; a null key counts as the smallest.
    """
    small_batches(rows.sparkSession)
    named = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")).withColumn(ROW, F.xxhash64("key", "vector"))
    good = named.filter(usable(F.col("vector"))).dropDuplicates(["key", ROW])
    classes = good.groupBy("vector").agg(F.min(F.struct("key", ROW)).alias("first"), F.count("*").alias("copies"))
    classes = settle(classes.select("vector", F.col("first.key").alias("class_id"), F.col("first")[ROW].alias("node"), "copies"), "vectors")
    turned = settle(classes.select("vector", "node", "copies").mapInPandas(_rotate, "node long, copies long, dims int, raw binary, turned binary"), "turned")
    cells = settle(turned.select("node", "dims", "turned").mapInPandas(_cells(cosine), "node long, dims int, number int, x long, y long, home boolean"), "cells")
    cell = ["dims", "number", "x", "y"]
    parts = cells.groupBy(*cell).agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).filter("n > 1 and homes > 0")
    sized = cells.join(parts.withColumn("parts", F.ceil(F.col("n") / PART)).drop("n", "homes"), cell).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    meet = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
        lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), F.when(F.col("own") < o, 0).when(F.col("own") > o, 1).otherwise(2).alias("side")),
    )
    met = sized.select("node", *cell, "home", F.explode(meet).alias("p")).select(
        F.xxhash64(*cell, "p.i", "p.j").alias("part"), "node", "number", "home", F.col("p.side").cast("int").alias("side")
    )
    met = met.join(turned, "node").repartition("part").sortWithinPartitions("part")
    links = settle(met.mapInPandas(_pairs(cosine), "node long, links long, root long"), "links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = settle(components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))), "joined")
    names = classes.select("node", "class_id")
    least = joined.join(names, "node").groupBy("component").agg(F.min(F.struct("class_id")).alias("least"))
    known = joined.join(least, "component").select("node", F.col("least.class_id").alias("reached"), F.lit(True).alias("found"))
    about = classes.join(counts, "node", "left").join(known, "node", "left").select(
        F.col("vector").alias("v"), F.when(F.col("found"), F.col("reached")).otherwise(F.col("class_id")).alias("component_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    out = good.join(about, F.col("vector") == F.col("v")).select(F.col("key").alias(key), "n_links", "component_id")
    odd = named.filter(~usable(F.col("vector"))).dropDuplicates(["key", ROW])
    return out.unionByName(odd.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id")))


def op9_subspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(read(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
