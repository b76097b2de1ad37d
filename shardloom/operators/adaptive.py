"""The adaptive checkpoint policy along runs of any length.

The policy saves at a step that depends on the last save alone. So every row
points to the row that would be saved next if it were saved itself, at most
``max_steps`` on, and the saves are the chain of pointers from the first row of
the run. The rows are split by ranges of (run, step). A slice can be entered only
from one of the last ``max_steps`` steps before it: for each of them a task
follows the chain through its slice and tells with which save it ends. These
small tables are joined with themselves, each round doubling the slices that a
row spans, until the save before every slice is known; then all slices follow
their chains side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.operators.ordered import SLICE, lay_out
from shardloom.session import settled

HANDED = ["run", SLICE, "step", "loss", "next", "to_step", "to_loss"]


def due_adaptive(steps: DataFrame, min_steps: int, max_steps: int, loss_threshold: float, slices: int | None = None) -> DataFrame:
    """Steps at which the adaptive policy saves, from (run, step, loss).

    The rule is ours: counted from the last save (or the first step), save after
    at least ``min_steps`` when the loss has dropped by the threshold since
    then, and after ``max_steps`` in any case. A missing loss is no drop; rows
    without a step take no part; rows of one step go by their loss.
    """
    if min_steps < 1 or max_steps < 1:
        raise ValueError("the policy needs at least one step between saves")
    rule = min_steps, max_steps, loss_threshold
    kind = steps.schema["run"].dataType.simpleString()
    slim = steps.filter("step is not null").select("run", F.col("step").cast("bigint").alias("step"), F.col("loss").cast("double").alias("loss"))
    laid = lay_out(slim, ["run", "step"], slices)
    parts = slices or int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "run", SLICE).sortWithinPartitions(SLICE, "run", "step", "loss")

    own = laid.select("run", SLICE, "step", "loss", F.lit(False).alias("earlier"))
    known = _entries(laid, own, rule, kind, dealt)
    rows = own if known is None else own.union(known.withColumn("earlier", F.lit(True)))
    return dealt(rows).mapInPandas(_chains(rule), f"run {kind}, step bigint, loss double")


def _entries(laid: DataFrame, own: DataFrame, rule: tuple, kind: str, dealt) -> DataFrame | None:
    """(run, slice, step, loss): the last save before each slice that goes on with a run; None if all runs have one."""
    along = Window.partitionBy("run").orderBy(SLICE)
    spans = laid.groupBy("run", SLICE).agg(F.max("step").alias("last"))
    spans = spans.select("run", SLICE, F.lag("last").over(along).alias("before"), F.lead(SLICE).over(along).alias("next"))
    # A slice shares at most its first and its last run with others.
    links = settled(spans.filter("before is not null or next is not null"), "links")
    longest = links.groupBy("run").count().agg(F.max("count")).first()[0]
    if longest is None:
        return None
    onward = F.broadcast(links.filter("next is not null"))
    same = F.col("r.run").eqNullSafe(F.col("l.run"))
    inner = own.alias("r").join(onward.alias("l"), same & (F.col(f"r.{SLICE}") == F.col(f"l.{SLICE}")), "left_semi")
    # Steps in (before - max_steps, before] lie in two of the buckets of that width.
    width = F.lit(rule[1])
    bucket = F.floor(F.col("before") / width)
    reach = F.broadcast(onward.filter("before is not null").select("run", SLICE, "before", F.explode(F.array(bucket, bucket - 1)).alias("bucket")))
    near = same & (F.floor(F.col("r.step") / width) == F.col("l.bucket")) & (F.col(f"r.{SLICE}") < F.col(f"l.{SLICE}"))
    near &= (F.col("r.step") > F.col("l.before") - width) & (F.col("r.step") <= F.col("l.before"))
    halo = laid.alias("r").join(reach.alias("l"), near).select("r.run", f"l.{SLICE}", "r.step", "r.loss", F.lit(True).alias("earlier"))
    ends = dealt(inner.union(halo)).mapInPandas(_exits(rule), f"run {kind}, {SLICE} int, step bigint, loss double, to_step bigint, to_loss double")
    handed = ends.alias("r").join(onward.alias("l"), same & (F.col(f"r.{SLICE}") == F.col(f"l.{SLICE}")))
    handed = settled(handed.select("r.run", f"r.{SLICE}", "r.step", "r.loss", "l.next", "r.to_step", "r.to_loss").distinct(), "handed")
    known = handed.filter("step is null").select("run", "next", "to_step", "to_loss").toDF("run", SLICE, "step", "loss")
    jumps = handed.filter("step is not null")
    reached = 1
    while reached < longest - 1:
        known = settled(known.union(_joined(known, jumps).select("l.run", "r.next", "r.to_step", "r.to_loss")), "known")
        reached *= 2
        if reached < longest - 1:
            left = jumps.toDF("run", "from", "from_step", "from_loss", SLICE, "step", "loss")
            twice = _joined(left, jumps).select("l.run", "l.from", "l.from_step", "l.from_loss", "r.next", "r.to_step", "r.to_loss")
            jumps = settled(twice.toDF(*HANDED), "jumps")
    return known


def _joined(left: DataFrame, jumps: DataFrame) -> DataFrame:
    """``left`` joined with the jumps that start at its (run, slice, step, loss)."""
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("run", SLICE, "step", "loss")]
    return left.alias("l").join(jumps.alias("r"), on)


def _heads(rows: pd.DataFrame) -> np.ndarray:
    """Where a (slice, run) begins, the first row left out."""
    run = pd.factorize(rows["run"], use_na_sentinel=False)[0]
    part = rows[SLICE].to_numpy()
    return np.flatnonzero((run[1:] != run[:-1]) | (part[1:] != part[:-1])) + 1


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Frames of whole (slice, run) stretches, with the places of each; a task holds a batch and one stretch."""

    def placed(frames: list[pd.DataFrame]):
        rows = pd.concat(frames, ignore_index=True)
        heads = _heads(rows)
        return rows, list(zip([0, *heads], [*heads, len(rows)]))

    held: list[pd.DataFrame] = []
    for rows in batches:
        if rows.empty:
            continue
        last = held[-1].iloc[-1:] if held else rows.iloc[:1]
        heads = _heads(pd.concat([last, rows], ignore_index=True)) - 1
        if len(heads):
            whole = [*held, rows.iloc[: heads[-1]]]
            if sum(map(len, whole)):
                yield placed(whole)
            held = [rows.iloc[heads[-1] :]]
        else:
            held.append(rows)
    if held:
        yield placed(held)


def _pointer(rows: pd.DataFrame, rule: tuple):
    """``following(i, end)``: the row saved next after row i, or ``end`` if none of the rows before that is."""
    min_steps, max_steps, threshold = rule
    step, loss = rows["step"].to_numpy(np.int64), rows["loss"].to_numpy(np.float64)

    def following(i: int, end: int) -> int:
        ahead = step[i + 1 : end]
        low, high = np.searchsorted(ahead, (step[i] + min_steps, step[i] + max_steps))
        hits = loss[i] - loss[i + 1 + low : i + 1 + high] >= threshold
        if hits.any():
            high = low + int(hits.argmax())
        return i + 1 + int(high)

    return following


def _exits(rule: tuple):
    """Per stretch and possible last save before it (none at the start of a run): the last save at its end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, places in _stretches(batches):
            following = _pointer(rows, rule)
            earlier = rows["earlier"].to_numpy()
            entry, ending, first = [], [], []
            for head, end in places:
                own = head + int(earlier[head:end].sum())
                final: dict[int, int] = {}
                for start in range(head, max(own, head + 1)):
                    # Saved before the slice and followed by a save before it: not the last one.
                    if start < own and following(start, end) < own:
                        continue
                    path, at = [], start
                    while at not in final:
                        path.append(at)
                        on = following(at, end)
                        if on == end:
                            final[at] = at
                        else:
                            at = on
                    final.update(dict.fromkeys(path, final[at]))
                    entry.append(start)
                    ending.append(final[start])
                    first.append(start >= own)
            out = rows.iloc[entry][["run", SLICE, "step", "loss"]].reset_index(drop=True)
            first = np.array(first, dtype=bool)
            out["step"], out["loss"] = out["step"].astype("Int64").mask(first), out["loss"].mask(first)
            out["to_step"], out["to_loss"] = rows["step"].to_numpy()[ending], rows["loss"].to_numpy()[ending]
            yield out

    return run


def _chains(rule: tuple):
    """The saves of each stretch, from the save before it or the first row of the run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, places in _stretches(batches):
            following = _pointer(rows, rule)
            saved = []
            for head, end in places:
                at = following(head, end)
                while at < end:
                    saved.append(at)
                    at = following(at, end)
            yield rows.iloc[saved][["run", "step", "loss"]]

    return run
