"""Running values along an order, for groups of any size.

A plain window puts each group into one task. Here the table is split by ranges
of (group, order) into as many slices as there are shuffle partitions and written
once with its slice number; one hot group simply spans many slices. Each slice is
summarised, the summaries (at most two groups a slice matter) are accumulated and
broadcast, and the windows then run inside the slices only. Tables of all sizes
take this way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.session import settled

SLICE = "__slice"


def lay_out(df: DataFrame, order: Sequence[str], slices: int | None = None) -> DataFrame:
    """``df`` written once, split by ranges of ``order``, with the slice of each row.

    Written, because a second sampling of the ranges might cut elsewhere; passes
    over it and lost executors re-read files.
    """
    parts = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *[F.col(c) for c in order]).withColumn(SLICE, F.spark_partition_id())
    return settled(cut, "ordered")


def ordered(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    position: str | None = None,
    total: str | None = None,
    sums: Mapping[str, str] | None = None,
    max_before: Mapping[str, str] | None = None,
    previous: Mapping[str, str] | None = None,
    slices: int | None = None,
    laid_out: bool = False,
) -> DataFrame:
    """Add running columns per group; ``order`` (ascending) must be unique in it.

    ``position`` is the place from 0, ``total`` the rows of the group, ``sums``
    running sums with the row itself, ``max_before`` the largest value of earlier
    rows and ``previous`` the value of the row before, each as {new: source}.
    With ``laid_out`` the input comes from ``lay_out`` along the same order and
    the result keeps its slices.
    """
    by, order = list(by), list(order)
    sums, max_before, previous = dict(sums or {}), dict(max_before or {}), dict(previous or {})
    sliced = df if laid_out else lay_out(df, by + order, slices)
    # A slice shares at most its first and its last group with others.
    carry = F.broadcast(_carry(sliced, by, order, sums, max_before, previous))
    keys = [SLICE, *by]
    left, right = sliced.alias("l"), carry.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = left.join(right, same, "left").select(
        "l.*", *[F.col(f"r.{c}") for c in carry.columns if c not in keys]
    )
    out = _windows(joined, [*by, SLICE], order, position, total, sums, max_before, previous)
    for name, start in ((position, "__n"), (total, "__rest")):
        if name:
            out = out.withColumn(name, F.col(name) + F.coalesce(F.col(start), F.lit(0)))
    for name in sums:
        out = out.withColumn(name, F.coalesce(F.col(name) + F.col(f"__s_{name}"), F.col(name), F.col(f"__s_{name}")))
    for name in max_before:
        out = out.withColumn(name, F.greatest(F.col(name), F.col(f"__m_{name}")))
    first = F.col("__first")
    for i, name in enumerate(previous):
        out = out.withColumn(name, F.when(first, F.col(f"__last.p{i}")).otherwise(F.col(name)))
    new = [name for name in (position, total) if name] + [*sums, *max_before, *previous]
    return out.select(*[c for c in sliced.columns if c not in new and (laid_out or c != SLICE)], *new)


def _windows(df, by, order, position, total, sums, max_before, previous):
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    w = group.orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    added = {}
    if position:
        added[position] = (F.row_number().over(w) - 1).cast("bigint")
    if total:
        added[total] = F.count(F.lit(1)).over(group)
    added.update({n: F.sum(c).over(upto) for n, c in sums.items()})
    added.update({n: F.max(c).over(before) for n, c in max_before.items()})
    added.update({n: F.lag(c).over(w) for n, c in previous.items()})
    if SLICE in by and previous:
        added["__first"] = F.row_number().over(w) == 1
    return df.withColumns(added)


def _carry(sliced, by, order, sums, max_before, previous):
    """What earlier (and later) slices of a group hand to each of its slices."""
    aggregates = [F.count(F.lit(1)).alias("__rows")]
    aggregates += [F.sum(c).alias(f"__s_{n}") for n, c in sums.items()]
    aggregates += [F.max(c).alias(f"__m_{n}") for n, c in max_before.items()]
    if previous:
        values = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(previous.values())])
        aggregates.append(F.max_by(values, F.struct(*order)).alias("__last"))
    summary = sliced.groupBy(*by, SLICE).agg(*aggregates)
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    w = group.orderBy(SLICE)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    columns = [
        *by,
        SLICE,
        F.count(F.lit(1)).over(group).alias("__spans"),
        F.sum("__rows").over(before).alias("__n"),
        (F.sum("__rows").over(group) - F.col("__rows")).alias("__rest"),
        *[F.sum(f"__s_{n}").over(before).alias(f"__s_{n}") for n in sums],
        *[F.max(f"__m_{n}").over(before).alias(f"__m_{n}") for n in max_before],
    ]
    if previous:
        columns.append(F.lag("__last").over(w).alias("__last"))
    return summary.select(*columns).filter("__spans > 1").drop("__spans")
