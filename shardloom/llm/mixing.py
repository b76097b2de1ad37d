"""Mixing sources to target weights by entropy balancing.

Each source wants a number of words. Document rates stay as close as possible to
1 (in relative entropy, each rate between 0 and a cap) while the words of every
source meet its target. The convex dual has one multiplier per source, and the
rate of a document is ``min(cap, exp(multiplier * size / mean size))``. Newton
steps on the dual run over the (source, size) histogram, all sources at once,
with a bisection bracket around each. Rates then become whole copies.

No rows of documents move but one narrow shuffle at the end: equal sizes of one
source share a rate, so everything before works on the histogram.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.llm.common import read, settle, whole

# Source weights by rank, repeating, and the largest share of itself a source may reach.
WEIGHTS = [5.0, 2.0, 1.0]
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BIN = 256


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=tuple(WEIGHTS), cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources rank by code point, null last. The total size is shared by weight;
    a target stops at ``cap`` times its source, and the excess goes to the others
    by weight until none is above. That end point is ``min(cap * size, level *
    weight)`` for one level, found by one pass over the sources in the order in
    which they fill up. One row per source, so one task holds them.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(everything) - 1) % len(weights))
    ranked = sizes.withColumn("weight", weight).withColumn("room", F.col("source_size") * float(cap))
    fill = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("full", F.col("room") <= F.col("level") * F.col("weight"))
        .withColumn("place", F.row_number().over(fill))
        # The first source that stays open sets the level; later rows only guessed theirs.
        .withColumn("level", F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(whole)["level"])
    )
    target = F.least("room", F.col("level") * F.col("weight"))
    return filled.select("source", "source_size", target.cast("double").alias("target"))


def balance(hist: DataFrame, targets: DataFrame, cap: float = CAP, tolerance: float = 1e-9, max_steps: int = 60) -> DataFrame:
    """(source, multiplier, mean) that meet the targets; null multiplier: every rate is the cap.

    ``hist`` has (source, size, n). The state is one row per source and goes
    through the shared folder each step; one number a step reaches the driver.
    """
    log_cap = math.log(cap)
    per = hist.groupBy("source").agg(F.sum("n").alias("docs"))
    state = (
        targets.join(per, targets.source.eqNullSafe(per.source)).select(
            targets.source, "target", (F.col("source_size") / F.col("docs")).alias("mean"),
            (F.col("target") >= F.col("source_size") * float(cap) * (1 - 1e-12)).alias("fixed"),
            F.lit(0.0).alias("x"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("gap"),
        )
    )
    state = settle(state, "dual")
    h = hist.select(F.col("source").alias("s"), "size", "n")
    for _ in range(max_steps):
        z = F.least(F.col("x") * F.col("size") / F.col("mean"), F.lit(log_cap))
        words = F.col("n") * F.col("size") * F.exp(z)
        slope = F.when(z < log_cap, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = (
            h.join(state.filter("not fixed and mean > 0 and gap > 0"), F.col("s").eqNullSafe(F.col("source")))
            .groupBy("source").agg(F.sum(words).alias("g"), F.sum(slope).alias("dg")).withColumnRenamed("source", "s")
        )
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        near = F.abs(F.col("g") - F.col("target")) <= tolerance * F.col("target")
        low = F.when(F.col("g") < F.col("target"), F.col("x")).otherwise(F.col("low"))
        high = F.when(F.col("g") > F.col("target"), F.col("x")).otherwise(F.col("high"))
        # Newton on the logarithm of the words: close to linear in the multiplier.
        step = F.col("x") + F.try_divide(F.log(F.try_divide(F.col("target"), F.col("g"))) * F.col("g"), F.col("dg"))
        within = step.isNotNull() & (low.isNull() | (step > low)) & (high.isNull() | (step < high)) & (F.abs(step - F.col("x")) <= 16 * (1 + F.abs(F.col("x"))))
        halved = F.when(low.isNull(), high - 1 - F.abs(high)).when(high.isNull(), low + 1 + F.abs(low)).otherwise((low + high) / 2)
        stuck = low.isNotNull() & high.isNotNull() & (high - low <= 1e-14 * (1 + F.abs(high)))
        done = F.col("g").isNull() | near | stuck
        state = settle(
            joined.select(
                "source", "target", "mean", "fixed",
                F.when(done, F.col("x")).when(within, step).otherwise(halved).alias("x"),
                F.when(done, F.col("low")).otherwise(low).alias("low"), F.when(done, F.col("high")).otherwise(high).alias("high"),
                F.when(done, 0.0).otherwise(1.0).alias("gap"),
            ),
            "dual",
        )
        if state.filter("gap > 0").isEmpty():
            break
    return state.select("source", F.when(~F.col("fixed"), F.col("x")).alias("multiplier"), "mean")


def _round_rates(cap: int):
    """Whole copies per size class of a source, long documents first.

    A class takes what its rates ask plus the words that longer classes left
    open, as near as its size allows, so the error ends below the shortest texts.
    """

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False, kind="stable")
        took, owed = [], 0.0
        for size, n, rate in zip(rows["size"].tolist(), rows["n"].tolist(), rows["rate"].tolist()):
            if size == 0:
                took.append(n)
                continue
            owed += rate * size * n
            copies = min(cap * n, max(0, math.floor(owed / size + 0.5)))
            owed -= copies * size
            took.append(copies)
        return rows[["source", "size", "n"]].assign(copies=took)

    return run


def mix(docs: DataFrame, key: str, source: str, size: Column, weights=tuple(WEIGHTS), cap: int = CAP) -> DataFrame:
    """(key, source, size, source_size, target, copies) for every row of ``docs``, of which it reads no more than that.

    Within a size class of a source the copies are dealt by a hash of the key:
    all get the same number, and the lowest hashes one more. Classes are cut into
    bins of about ``ROWS_PER_BIN`` hashes, so a source or a size that holds most
    rows still spreads. A null source is a source; documents without words get
    one copy; equal keys of equal size are interchangeable; no rows give no rows.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"))
    rows = rows.withColumn("hash", F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("\0"))))
    hist = settle(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    targets = settle(
        source_targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap), "targets"
    )
    dual = balance(hist, targets, cap).withColumnRenamed("source", "s")
    scaled = F.try_divide(F.col("multiplier") * F.col("size"), F.col("mean"))
    exponent = F.when(scaled.isNotNull(), F.least(scaled, F.lit(math.log(cap))))
    rated = hist.join(dual, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "size", "n", F.when(F.col("multiplier").isNull(), float(cap)).otherwise(F.coalesce(F.exp(exponent), F.lit(1.0))).alias("rate")
    )
    # One group per source holds one row per distinct size.
    whole = rated.groupBy("source").applyInPandas(_round_rates(cap), "source string, size long, n long, copies long")
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    plan = settle(
        whole.join(t, F.col("source").eqNullSafe(F.col("s"))).select(
            F.col("source").alias("p_source"), F.col("size").alias("p_size"), "source_size", "target",
            F.floor(F.col("copies") / F.col("n")).alias("base"), (F.col("copies") % F.col("n")).alias("extra"),
            F.ceil(F.col("n") / ROWS_PER_BIN).alias("bins"),
        ),
        "plan",
    )
    keyed = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    # Where the hash falls among the bins of its class: an order of hashes, cut evenly.
    place = (F.col("hash").cast("double") / F.lit(2.0**64) + 0.5) * F.col("bins")
    binned = keyed.withColumn("__bin", F.least(F.floor(place), F.col("bins") - 1))
    klass = ["p_source", "p_size"]
    counts = binned.filter("extra > 0").groupBy(*klass, "__bin").agg(F.count("*").alias("in_bin"), F.first("extra").alias("extra"))
    upto = Window.partitionBy(*klass).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    share = settle(
        counts.withColumn("left", F.col("extra") - F.coalesce(F.sum("in_bin").over(upto), F.lit(0))).filter("left > 0").select(
            *[F.col(k).alias(f"b_{k}") for k in klass], F.col("__bin").alias("b_bin"), "left", (F.col("left") < F.col("in_bin")).alias("cut")
        ),
        "bins",
    )
    dealt = binned.join(
        share, F.col("p_source").eqNullSafe(F.col("b_p_source")) & (F.col("p_size") == F.col("b_p_size")) & (F.col("__bin") == F.col("b_bin")), "left"
    )
    # Only the bin in which the extra copies run out needs an order.
    rank = F.row_number().over(Window.partitionBy(*klass, "__bin").orderBy("hash", "key"))
    told = ["key", "source", "size", "source_size", "target"]
    even = dealt.filter(F.col("left").isNull() | ~F.col("cut")).select(
        *told, (F.col("base") + F.when(F.col("left").isNull(), 0).otherwise(1)).alias("copies")
    )
    cut = dealt.filter("cut").withColumn("__rank", rank).select(
        *told, (F.col("base") + F.when(F.col("__rank") <= F.col("left"), 1).otherwise(0)).alias("copies")
    )
    return even.unionByName(cut)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    sized = settle(docs, "words")
    mixed = mix(sized, "doc_id", "source", F.col("words"))
    return mixed.select(
        F.col("key").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", F.col("copies").cast("long").alias("copies"),
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a row for every copy taken, none for a document left out.

    Rows equal in doc_id, source and text share their copies.
    """
    row = F.xxhash64("doc_id", "source", "text")
    keyed = docs.select(whole(docs).alias("doc"), row.alias("row"), "source", word_count(F.col("text")).alias("words"))
    sized = settle(keyed.select("row", "source", "words"), "words")
    mixed = mix(sized, "row", "source", F.col("words"))
    taken = mixed.groupBy("key").agg(F.sum("copies").cast("long").alias("take"), F.count("*").alias("times")).filter("take > 0")
    joined = keyed.select("doc", "row").join(settle(taken, "taken"), F.col("row") == F.col("key"))
    once = joined.filter("times = 1")
    again = joined.filter("times > 1").dropDuplicates(["row"])
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("take")))
    return once.union(again).select("doc", each).select("doc.*")
