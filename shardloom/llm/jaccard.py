"""Near-duplicate documents by a chosen-path join over word shingles.

Every document has the set of its five-word shingles and, drawn from it, a
sketch of minhash values; two sets agree in a place of the sketch with the
probability of their Jaccard similarity. A run splits all documents by the
values of a few sampled places: a bucket holds documents that share a value on
the chosen path. Buckets above a limit split again on freshly sampled places
each with probability 1 / (threshold x places), so similar pairs stay together
on some path and others part. Small buckets are compared pair by pair on their
sketches. Runs repeat until one more finds (almost) nothing new.

What the buckets join, and more, comes together as groups. Only then are the
shingle sets of grouped documents moved, once, and every pair inside a group is
verified by its exact similarity; groups too large for a task meet block by block.
Documents with equal shingle sets are one class throughout. No pair is ever a
row: buckets hand on the edges of a spanning forest, blocks counts of links.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import bits
from shardloom.llm.common import components, forest, read, row_key, settle, small_batches, whole

WORDS = 5
SIMILARITY = 0.8
PLACES = 64
SLOTS = 16  # paths at the top of a run, of two places each
FIRST = 2
RUN_LIMIT = 8
RECALL = 0.999
SMALL = 4096  # rows of a bucket compared pair by pair: half a second at most
TOGETHER = 16_384  # rows of a bucket that a task splits on by itself
DEPTH = 8
MARGIN = 0.2  # four standard deviations of the similarity that 64 places show
BLOCK = 1024
CHUNK = 1_000_000
ROW = "__row"
U64 = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the distinct shingle hashes of each text, sorted, and where each text's end.

    Words are what white space (ASCII) leaves; a text of fewer words than a
    shingle is one shingle of all of them, one without words has none.
    """
    n = len(offsets) - 1
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~space
    begins = word.copy()
    begins[1:] &= space[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = word[heads]
    start = np.flatnonzero(begins)
    stops = word.copy()
    stops[:-1] &= space[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    stops[tails] = word[tails]
    end = np.flatnonzero(stops) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    if not len(start):
        return np.empty(0, U64), np.zeros(n, np.int64)
    hashed = bits.Substrings(data, 5)(start, end - start)
    many = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(many)[:-1]])
    place = np.arange(len(start)) - first[doc]
    size = np.minimum(many, words)[doc]
    keep = place + size <= many[doc]
    at = np.flatnonzero(keep)
    total = np.zeros(len(at), U64)
    for k in range(words):
        inside = k < size[at]
        total = np.where(inside, bits.mixed(total * bits.BASE + hashed[np.minimum(at + k, len(hashed) - 1)]), total)
    doc = doc[at]
    order = np.lexsort((total, doc))
    total, doc = total[order], doc[order]
    new = np.concatenate([[True], (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])])
    return total[new], np.cumsum(np.bincount(doc[new], minlength=n))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(64)
    return rng.integers(0, 2**62, PLACES, dtype=U64) * U64(2) + U64(1), rng.integers(0, 2**63, PLACES, dtype=U64)


def sketches(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(texts, PLACES) minhash values of 32 bits; rows of empty sets are 0."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    some = np.flatnonzero(ends > starts)
    out = np.zeros((len(ends), PLACES), np.uint32)
    if len(some):
        for k, (a, b) in enumerate(zip(*_multipliers())):
            h = hashes * a
            h ^= b
            h *= bits.MIX
            # The smallest of many hashes is small: mixed again, its 32 bits tell it from others.
            out[some, k] = bits.mixed(np.minimum.reduceat(h, starts[some])) >> U64(32)
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = bits.text_bytes(batch.column("text"))
        for low, high in bits.spans(offsets, CHUNK):
            hashes, ends = shingles(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            sketch = sketches(hashes, ends)
            own = [hashes[a:b].tobytes() for a, b in zip(starts, ends)]
            sets = [xxhash.xxh3_128_digest(x) for x in own]
            part = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column(ROW), pa.array(sets, pa.binary()), pa.array((ends - starts).astype(np.int32)), pa.array([x.tobytes() for x in sketch], pa.binary())],
                ["doc_id", ROW, "class", "size", "sketch"],
            )


def _slots(run: int, depth: int, path: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, places) choices for rows with these path hashes: at the top SLOTS pairs of places, below each place by chance.

    Two places at once keep apart most texts that only share a common passage.
    """
    if depth == 0:
        chosen = np.random.default_rng(1000 + run).permutation(PLACES)[: SLOTS * FIRST].reshape(SLOTS, FIRST)
        return [(np.arange(len(path)), places) for places in chosen]
    bar = U64(int(2**64 / (SIMILARITY * PLACES)))
    out = []
    for p in range(PLACES):
        rows = np.flatnonzero(bits.mixed(path + U64((p + 1) * int(bits.BASE) % 2**64)) < bar)
        if len(rows):
            out.append((rows, np.array([p])))
    return out


def _split(run: int, depth: int):
    """Rows (node, sketch, path) to their buckets one level down; below the top with their sketches."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, PLACES)
            rows, path = _below(run, depth, batch.column("path").to_numpy().astype(np.int64).view(U64), sketch)
            take = pa.array(rows)
            columns = [batch.column("node").take(take), pa.array(path.view(np.int64))]
            if depth:
                columns.append(batch.column("sketch").take(take))
            yield pa.RecordBatch.from_arrays(columns, ["node", "path", "sketch"][: len(columns)])

    return go


def _below(run: int, depth: int, path: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, path): the buckets one level down that rows with these paths fall into."""
    rows, keys = [np.empty(0, np.int64)], [np.empty(0, U64)]
    for own, places in _slots(run, depth, path):
        key = path[own]
        for place in places:
            key = bits.mixed(bits.mixed(key + sketch[own, place].astype(U64) * bits.BASE) + U64(int(place) + (run << 8)))
        keys.append(key)
        rows.append(own)
    return np.concatenate(rows), np.concatenate(keys)


def _compare(run: int, depth: int):
    """Buckets, sorted by path: edges (a, b) of a forest over the pairs whose sketches agree enough.

    Buckets of more than SMALL rows split on here, level by level, as they do
    between tasks while they are too large for one.
    """

    def edges(path, node, sketch):
        path, row = path.view(U64), np.arange(len(node))
        left, right, sure, level = [], [], [], depth
        while True:
            order = np.argsort(path, kind="stable")
            path, row = path[order], row[order]
            heads = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            many = np.repeat(np.diff(np.append(heads, len(path))), np.diff(np.append(heads, len(path))))
            small = (many > 1) & (many <= SMALL)
            own, at = path[small], row[small]
            for back in range(1, int(many[small].max(initial=1))):
                later = np.arange(back, len(own))
                later = later[own[later] == own[later - back]]
                agree = (sketch[at[later]] == sketch[at[later - back]]).mean(1)
                good = later[agree >= SIMILARITY - MARGIN]
                left.append(at[good - back])
                right.append(at[good])
                sure.append(agree[agree >= SIMILARITY - MARGIN] >= SIMILARITY)
            path, row, many = path[many > SMALL], row[many > SMALL], many[many > SMALL]
            if not len(path):
                break
            if level == DEPTH:
                # So many shared values leave hardly anything but near copies: a group, verified later.
                new = np.concatenate([[True], path[1:] != path[:-1]])
                left.append(row)
                right.append(row[np.flatnonzero(new)][np.cumsum(new) - 1])
                sure.append(np.ones(len(row), bool))
                break
            level += 1
            kept, path = _below(run, level, path, sketch[row])
            row = row[kept]
            if not len(path):
                break
        if not left:
            return None
        pairs = np.stack([node[np.concatenate(left)], node[np.concatenate(right)]], 1)
        names, at = np.unique(pairs, return_inverse=True)
        if not len(names):
            return None
        at, strong = at.reshape(-1, 2), np.concatenate(sure)
        root, near = forest(at[:, 0], at[:, 1], names), forest(at[strong, 0], at[strong, 1], names)
        # Stars of the likely links, and edges from their roots for the rest.
        hung, rest = names != near, (names == near) & (names != root)
        a, b = np.concatenate([names[hung], names[rest]]), np.concatenate([near[hung], root[rest]])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) < hung.sum())], ["a", "b", "likely"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list | None = None
        for batch in batches:
            own = [batch.column("path").to_numpy(), batch.column("node").to_numpy(), np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, PLACES)]
            if rest is not None:
                own = [np.concatenate([x, y]) for x, y in zip(rest, own)]
            cut = int(np.searchsorted(own[0], own[0][-1], "left"))
            rest = [x[cut:] for x in own]
            if cut and (out := edges(*[x[:cut] for x in own])) is not None:
                yield out
        if rest is not None and len(rest[0]) and (out := edges(*rest)) is not None:
            yield out

    return go


def chosen_paths(classes: DataFrame, run: int, groups: DataFrame | None = None) -> DataFrame:
    """(a, b, likely): edges among ``classes`` (node, sketch) that one run finds.

    ``likely`` ones link sketches that agree in as many places as similar sets do.

    Buckets whose rows earlier runs have put into one of the ``groups`` (node,
    component) cannot add anything and go no further.
    """
    level = classes.withColumn("path", F.lit(0).cast("long"))
    found = None
    for depth in range(DEPTH + 1):
        # At the top few rows share a bucket, so sketches follow when that is known.
        kind = "node long, path long, sketch binary" if depth else "node long, path long"
        split = settle(level.select("node", "sketch", "path").mapInArrow(_split(run, depth), kind), "paths")
        sizes = split.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("low")).filter("n > 1")
        full = split.join(sizes, "path")
        if groups is not None and not depth:
            known = full.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
            mixed = known.groupBy("path").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most")
            full = full.join(mixed.select("path"), "path", "left_semi")
        full = settle((full if depth else full.join(classes, "node")).select("node", "path", "n", "low", "sketch"), "buckets")
        fits = full.filter(F.col("n") <= TOGETHER).repartition("path").sortWithinPartitions("path")
        edges = fits.select("path", "node", "sketch").mapInArrow(_compare(run, depth), "a long, b long, likely boolean")
        found = edges if found is None else found.union(edges)
        level = full.filter(F.col("n") > TOGETHER)
        if level.isEmpty():
            break
    else:
        found = found.union(level.select(F.col("node").alias("a"), F.col("low").alias("b"), F.lit(True).alias("likely")))
    return settle(found.distinct(), "edges")


def _sets(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = bits.has_bit(bitmap.value, batch.column(ROW).to_numpy())
            batch = batch.filter(pa.array(wanted))
            data, offsets = bits.text_bytes(batch.column("text"))
            for low, high in bits.spans(offsets, CHUNK):
                hashes, ends = shingles(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                part = batch.slice(low, high - low)
                own = pa.array([hashes[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column(ROW), own], ["doc_id", ROW, "set"])

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by a product over the shingles that occur on both sides."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    rows_a = np.repeat(np.arange(len(left)), [len(x) for x in left])
    rows_b = np.repeat(np.arange(len(right)), [len(x) for x in right])
    col_a, col_b = np.searchsorted(common, a), np.searchsorted(common, b)
    in_a = common[np.minimum(col_a, len(common) - 1)] == a if len(common) else np.zeros(len(a), bool)
    in_b = common[np.minimum(col_b, len(common) - 1)] == b if len(common) else np.zeros(len(b), bool)
    step = max(256, 16_000_000 // max(1, len(left) + len(right)))
    for low in range(0, len(common), step):
        x, y = np.zeros((len(left), min(step, len(common) - low)), np.float32), np.zeros((len(right), min(step, len(common) - low)), np.float32)
        own = in_a & (col_a >= low) & (col_a < low + step)
        x[rows_a[own], col_a[own] - low] = 1
        own = in_b & (col_b >= low) & (col_b < low + step)
        y[rows_b[own], col_b[own] - low] = 1
        out += x @ y.T
    return out


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block pair of a group: links of each class by exact similarity, and a forest of them."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        # An own block takes part on both sides of itself.
        node = rows["node"].to_numpy()
        copies, side = rows["copies"].to_numpy(), rows["side"].to_numpy()
        sets = [np.frombuffer(x, U64) for x in rows["set"]]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        size = np.array([len(x) for x in sets], np.float32)
        shared = _overlaps([sets[i] for i in left], [sets[i] for i in right])
        union = size[left][:, None] + size[right][None, :] - shared
        # In whole numbers: 5 x shared >= 4 x union for a similarity of 0.8.
        linked = shared.astype(np.float64) >= SIMILARITY * union.astype(np.float64) - 1e-9
        linked &= node[left][:, None] != node[right][None, :]
        i, j = np.nonzero(linked)
        links = np.zeros(len(node), np.int64)
        np.add.at(links, left[i], copies[right[j]])
        if (side != 2).any():
            np.add.at(links, right[j], copies[left[i]])
        root = forest(left[i], right[j], node) if len(i) else node
        # Places follow the order of node, so the smallest place is the smallest node.
        told = pd.DataFrame({"node": node, "links": links, "root": root})
        return told[told["links"] > 0]

    rest = None
    for rows in batches:
        if rest is not None:
            rows = pd.concat([rest, rows], ignore_index=True)
        last = rows["block"].iloc[-1]
        rest = rows[rows["block"] == last]
        for _, own in rows[rows["block"] != last].groupby("block", sort=False):
            yield block(own.sort_values("node", ignore_index=True))
    if rest is not None and len(rest):
        yield block(rest.sort_values("node", ignore_index=True))


def _merged(groups: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """``groups`` (node, component) with the further ``edges``, and how many pairs of groups likely links join.

    Edges inside a group do not count.
    """
    own = groups.withColumnRenamed("node", "n")
    for end in ("a", "b"):
        lifted = edges.join(own, F.col(end) == F.col("n"), "left")
        edges = lifted.withColumn(end, F.coalesce("component", end)).drop("n", "component")
    between = settle(edges.filter("a <> b").groupBy("a", "b").agg(F.max("likely").alias("likely")), "between")
    if between.isEmpty():
        return groups, 0
    moved = settle(components(between).select(F.col("node").alias("from"), F.col("component").alias("to")), "moved")
    old = groups.join(moved, F.col("component") == F.col("from"), "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = moved.join(groups, F.col("from") == F.col("node"), "left_anti").select(F.col("from").alias("node"), F.col("to").alias("component"))
    return settle(old.union(fresh), "groups"), between.filter("likely").count()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, __row, component, n_links, class_id, grp) for every distinct row of ``docs`` (doc_id, __row, text).

    ``n_links`` counts the other documents of similarity ``SIMILARITY`` or more,
    copies included; ``component`` is the smallest doc_id that links reach, and
    ``class_id`` the smallest doc_id with the same shingle set. Words are lower
    case. Null texts and texts without words link with nothing. Rows equal in
    doc_id and text are one document; null doc_ids count as the smallest. ``grp``
    numbers the groups, also where doc_ids repeat.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lowered = docs.select("doc_id", ROW, F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    per = lowered.mapInArrow(_sketched, f"doc_id long, {ROW} long, class binary, size int, sketch binary")
    per = settle(per, "sketches")
    distinct = per.select("doc_id", ROW, "class", "size").filter("size > 0").distinct()
    # A class is known by its smallest document; its number is that row's key.
    first = F.min(F.struct("doc_id", ROW))
    classes = settle(
        distinct.groupBy("class").agg(first.alias("first"), F.count("*").alias("copies"))
        .select("class", F.col("first.doc_id").alias("class_id"), F.col("first")[ROW].alias("node"), "copies"),
        "classes",
    )
    sketched = per.join(classes.select(F.col("class").alias("c"), "class_id", F.col("node")), (F.col(ROW) == F.col("node")) & (F.col("class") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("class_id")))
    sketched = settle(sketched.select("node", "sketch").dropDuplicates(["node"]), "class-sketches")

    # What a run adds is judged by likely links: sets that only share a common
    # passage join by chance in every run and are told apart when verified.
    new = chosen_paths(sketched, 0)
    groups, joins = settle(components(new), "groups"), new.filter("likely").select("a").distinct().count()
    for run in range(1, RUN_LIMIT):
        groups, added = _merged(groups, chosen_paths(sketched, run, groups))
        joins += added
        if added <= (1 - RECALL) * joins:
            break
    else:
        warnings.warn(f"near duplicates: run {RUN_LIMIT} still added {added} of {joins} joins", stacklevel=2)

    grouped = groups.groupBy("component").agg(F.count("*").alias("n"))
    members = groups.join(grouped, "component").join(classes, "node")
    members = settle(members.select("node", "component", "n", "copies", "class_id"), "members")
    bitmap = spark.sparkContext.broadcast(bits.bit_map(members, "node"))
    found = lowered.mapInArrow(_sets(bitmap), f"doc_id long, {ROW} long, set binary")
    here = (F.col(ROW) == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    whole = found.join(members, here).drop("doc_id", ROW).dropDuplicates(["node"])
    blocks = F.ceil(F.col("n") / BLOCK)
    placed = whole.withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn("blocks", blocks)
    # Block pair (i, j), i <= j: block i stands left, block j right, an own pair on both sides (2).
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda o: F.struct(
            F.least("own", o).alias("i"), F.greatest("own", o).alias("j"),
            F.when(F.col("own") < o, 0).when(F.col("own") > o, 1).otherwise(2).alias("side"),
        ),
    )
    met = placed.select("node", "component", "copies", "set", F.explode(pairs).alias("p")).select(
        F.xxhash64("component", "p.i", "p.j").alias("block"), "node", "copies", "set", F.col("p.side").cast("int").alias("side")
    )
    met = met.repartition("block").sortWithinPartitions("block")
    verified = settle(met.mapInPandas(_verified, "node long, links long, root long"), "verified")
    counts = verified.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = joined.join(classes.select("node", "class_id"), "node").groupBy("component").agg(F.min(F.struct("class_id")).alias("least"))
    known = joined.join(least, "component").select("node", F.col("component").alias("grp"), F.col("least.class_id").alias("component"))
    alone = F.col("grp").isNull()
    about = classes.join(counts, "node", "left").join(known, "node", "left").select(
        F.col("class").alias("c"), "class_id", F.coalesce("grp", "node").alias("grp"),
        F.when(alone, F.col("class_id")).otherwise(F.col("component")).alias("component"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    about = settle(about, "about")
    out = distinct.join(about, F.col("class") == F.col("c")).select("doc_id", ROW, "component", "n_links", "class_id", "grp")
    bare = per.filter("size = 0").select("doc_id", ROW).distinct()
    none = F.lit(0).cast("long").alias("n_links")
    return out.unionByName(bare.select("doc_id", ROW, F.col("doc_id").alias("component"), none, F.col("doc_id").alias("class_id"), F.col(ROW).alias("grp")))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn(ROW, row_key())
    out = near_duplicates(docs)
    return out.select("doc_id", "class_id", "component", "n_links", F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Of rows that repeat a doc_id the smallest row key stays; rows that repeat
    doc_id and text are one document. Documents without words all stay.
    """
    keyed = docs.select(whole(docs).alias("doc"), "doc_id", "text", row_key().alias(ROW))
    told = settle(near_duplicates(keyed.select("doc_id", ROW, "text")), "near")
    keep = told.groupBy("grp").agg(F.min(F.struct("doc_id", ROW)).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k")[ROW].alias("__r"))
    times = keyed.groupBy("doc_id", ROW).agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("__i"), F.col(ROW).alias("__q"), F.lit(True).alias("__again"))
    keep = keep.join(times, (F.col("__r") == F.col("__q")) & F.col("__id").eqNullSafe(F.col("__i")), "left")
    keep = settle(keep.select("__id", "__r", F.coalesce("__again", F.lit(False)).alias("__again")), "keep")
    joined = keyed.join(keep, (F.col(ROW) == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    once = joined.filter(~F.col("__again")).select("doc.*")
    again = joined.filter("__again").dropDuplicates(["doc_id", ROW]).select("doc.*")
    return once.union(again)
