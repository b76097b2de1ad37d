"""The sliced paths give the same rows as plain windows and plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from shardloom.operators import adaptive, barriers, delivery, epochs, requests, training, workers
from shardloom.operators.ordered import SLICE, lay_out, ordered
from shardloom.sources import views
from shardloom.sources.tables import table

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows in one group, another group null, many ties in the time."""
    n = F.col("id")
    group = F.when(n % 3 == 0, "hot").when(n % 17 == 1, None).otherwise(F.concat(F.lit("g"), (n % 23).cast("string")))
    return spark.range(3000).select(
        group.alias("g"),
        F.floor(n / 40).alias("t"),
        n.alias("i"),
        ((n * 7919) % 101).alias("v"),
        F.when(n % 5 != 0, n % 13).alias("w"),
    )


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("per_slice", [4, 60])
def test_ordered_in_slices(hot, by, per_slice):
    def run(size):
        return ordered(
            hot, by, ["t", "i"], position="p", total="n", sums={"s": "w"}, max_before={"m": "v"},
            previous={"pv": "w", "pi": "i"}, slices=size,
        )

    assert rows(run(per_slice)) == rows(run(1))


def test_slices_grow_and_stay_even(hot):
    cut = lay_out(hot, ["g", "t", "i"], 30)
    sizes = cut.groupBy(F.col(SLICE).alias("s")).agg(F.count("*").alias("n"), F.min(F.struct("g", "t", "i")).alias("low"))
    got = [tuple(r) for r in sizes.orderBy("s").select("n", "low").collect()]
    assert len(got) > 20 and max(n for n, _ in got) < 400
    lows = [tuple("" if x is None else x for x in low) for _, low in got]
    assert lows == sorted(lows)


def test_no_row_windows_in_one_task(spark):
    orders = table(spark, SF_DIR, "orders").select("o_orderkey")
    plan = delivery.index_samples(orders, ["o_orderkey"])._jdf.queryExecution().executedPlan().toString()
    # One row per slice may meet in one task, the rows themselves never do.
    assert "FileScan parquet [o_orderkey" in plan and plan.count("SinglePartition") <= 2


def test_rate_limit_takes_few_jobs_whatever_the_slices(spark):
    df = spark.range(2000).select(F.lit("steady").alias("client"), F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 100_000).cast("timestamp_ntz").alias("ts"))
    jobs = []
    for slices in (20, 200):
        spark.sparkContext.setJobGroup(f"fold-{slices}", "")
        decided = requests.rate_limit(df, 10.0, 5, slices=slices)
        assert decided.count() == 2000
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fold-{slices}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 2


def test_shuffle_positions_use_ready_slices(spark):
    orders = table(spark, SF_DIR, "orders").select("o_orderkey")
    placed = delivery.shuffle_samples(orders, "o_orderkey", dataset="orders")
    total = orders.count()
    stats = placed.agg(F.min("position"), F.max("position"), F.count_distinct("position")).first()
    assert tuple(stats) == (0, total - 1, total)


def brute_force_limit(pairs, rate, burst):
    """The bucket rule, written again for one client at a time."""
    tokens, mark, out = float("nan"), None, {}
    for at, event in sorted(pairs):
        if mark is None:
            tokens, mark = burst, at
        whole = int(((at - mark) // 10**6 + (at - mark) % 10**6 * 1000 / 1e9) * rate)
        if whole:
            tokens, mark = min(burst, tokens + whole), at
        out[event] = tokens > 0
        tokens = max(0, tokens - 1)
    return out


@pytest.mark.parametrize("per_slice", [25, 1])
def test_rate_limit_against_brute_force(spark, per_slice):
    rng = random.Random(5)
    calls, at = [], 1_700_000_000_000_000
    for event in range(900):
        at += rng.choice([1_000, 20_000, 90_000, 150_000, 700_000])
        client = "hot" if event % 3 else f"c{event % 7}"
        calls.append((client, event, at))
    df = spark.createDataFrame(calls, "client string, event_id bigint, us bigint")
    df = df.select("client", "event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"))
    got = {r.event_id: r.allowed for r in requests.rate_limit(df, 10.0, 5, slices=per_slice).collect()}
    want = {}
    for client in {c for c, _, _ in calls}:
        want.update(brute_force_limit([(a, e) for c, e, a in calls if c == client], 10.0, 5))
    assert got == want and not all(got.values())


def saves(steps, min_steps, max_steps, drop):
    want, saved = [], {}
    for run, step, loss in sorted(steps, key=lambda r: (str(r[0]), r[1])):
        loss = float("nan") if loss is None else float(loss)
        at, before = saved.setdefault(run, (step, loss))
        if step - at >= max_steps or (step - at >= min_steps and before - loss >= drop):
            saved[run] = (step, loss)
            want.append((run, step))
    return sorted(want, key=str)


def test_adaptive_policy_against_a_loop(spark):
    steps = training.numbered_steps(views.runs(spark, SF_DIR))
    want = saves([(r.run, r.step, r.loss) for r in steps.collect()], 3, 12, 20.0)
    got = adaptive.due_adaptive(steps, 3, 12, 20.0)
    assert sorted(((r.run, r.step) for r in got.collect()), key=str) == want and want


@pytest.mark.parametrize("slices,rule", [(1, (3, 12, 20.0)), (16, (3, 12, 20.0)), (40, (1, 200, 45.0)), (25, (2, 7, 1000.0))])
def test_adaptive_policy_of_one_long_run(spark, slices, rule):
    """Two thirds of the rows in one run, steps with gaps, missing losses, a run without a name, runs of one row."""
    rng = random.Random(slices)
    rows = [("long", step, None if step % 41 == 0 else rng.uniform(0, 60)) for step in sorted(rng.sample(range(6000), 1500))]
    rows += [(None, step, float(600 - step)) for step in range(300)]
    rows += [(f"run{i % 90}", i // 90, rng.uniform(0, 60)) for i in range(400)]
    rows += [(f"one{i}", 5, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "run string, step bigint, loss double").repartition(3)
    got = adaptive.due_adaptive(df, *rule, slices=slices)
    assert sorted(((r.run, r.step) for r in got.collect()), key=str) == saves(rows, *rule)
    assert adaptive.due_adaptive(df.limit(0), *rule).count() == 0
    odd = df.union(spark.createDataFrame([("long", None, 1.0)], df.schema))
    assert adaptive.due_adaptive(odd, *rule, slices=slices).count() == got.count()
    if slices > 1:
        laid = lay_out(df, ["run", "step"], slices).filter("run = 'long'")
        assert laid.select(SLICE).distinct().count() > slices // 3


def test_event_operators_in_slices(spark):
    cases = [
        lambda n: barriers.barrier_arrivals(views.arrivals(spark, SF_DIR), 16, slices=n),
        lambda n: workers.heartbeat_gaps(views.heartbeats(spark, SF_DIR), 3600, slices=n),
        lambda n: training.numbered_steps(views.runs(spark, SF_DIR), slices=n),
        lambda n: training.windowed_loss(training.numbered_steps(views.runs(spark, SF_DIR)), 10, slices=n),
        lambda n: delivery.index_samples(
            table(spark, SF_DIR, "lineitem").select(*views.LINEITEM_ORDER), views.LINEITEM_ORDER, slices=n
        ),
        lambda n: delivery.index_samples(table(spark, SF_DIR, "documents").select("source", "doc_id"), ["source", "doc_id"], slices=n),
    ]
    for case in cases:
        assert rows(case(40)) == rows(case(1))


def test_epoch_order_in_slices(spark):
    from shardloom.operators.manifest import shard_ranges

    manifest = views.manifest(spark, SF_DIR)
    shards = epochs.with_epochs(shard_ranges(manifest), 2)
    assert rows(epochs.epoch_shard_order(shards, manifest, slices=20)) == rows(epochs.epoch_shard_order(shards, manifest))


def test_newest_per_group_with_a_hot_group(hot):
    top = requests.newest_per_group(hot.filter("g is not null"), ["g"], ["t", "i"], 10)
    want = {}
    for r in hot.filter("g is not null").collect():
        want.setdefault(r.g, []).append(r.i)
    for r in top.groupBy("g").agg(F.sort_array(F.collect_list("i")).alias("i")).collect():
        assert r.i == sorted(want[r.g])[-10:]
