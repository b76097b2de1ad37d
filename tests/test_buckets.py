"""Token buckets in slices against a plain walk, request by request."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.operators import buckets, requests


def walk(times, rate, burst, state=None):
    tokens, mark = state or (burst, times[0])
    out = []
    for now in times:
        elapsed = max(now - mark, 0)
        added = int((elapsed // 1_000_000 + (elapsed % 1_000_000 * 1000) / 1e9) * rate)
        if added > 0:
            tokens, mark = min(tokens + added, burst), now
        allowed = tokens > 0
        tokens -= allowed
        out.append((allowed, tokens, mark))
    return out


def times(rng, n, pace):
    now, out = rng.randrange(10**12), []
    for _ in range(n):
        now += rng.choice([0, 0, 1, rng.randrange(pace), rng.randrange(pace), rng.randrange(20 * pace)])
        out.append(now)
    return out


RATES = [(10.0, 5), (3.7, 1), (1 / 14400, 3), (1000.0, 50), (0.3, 2)]


@pytest.mark.parametrize("rate, burst", RATES)
def test_stretches_compose_to_the_walk(rate, burst):
    rng = random.Random(burst)
    need = buckets.pause_for_one(rate)
    assert int(buckets.tokens_after(np.array([need]), rate)[0]) >= 1 and int(buckets.tokens_after(np.array([need - 1]), rate)[0]) == 0
    for _ in range(60):
        t = times(rng, rng.randrange(1, 120), max(2, int(rng.choice([0.05, 0.5, 2]) * need)))
        state = (rng.randrange(burst + 1), t[0] - rng.randrange(3 * need))
        want = walk(t, rate, burst, state)
        got = buckets.decide(np.array(t), np.array([0]), np.array([state[0]]), np.array([state[1]]), need, rate, burst)
        assert list(zip(*[x.tolist() for x in got])) == want
        cuts = sorted({0, len(t), *(rng.randrange(len(t) + 1) for _ in range(4))})
        parts = [buckets.Stretch.of(np.array(t[a:b]), need, rate, burst) for a, b in zip(cuts, cuts[1:])]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.followed(p, need, rate, burst)
        assert whole.applied(*state, need, rate, burst) == want[-1][1:]
        at = state
        for p in parts:
            at = p.applied(*at, need, rate, burst)
        assert at == want[-1][1:]


def test_many_runs_at_once():
    rng = random.Random(3)
    runs = [times(rng, rng.randrange(1, 40), 300_000) for _ in range(50)]
    heads = np.cumsum([0, *map(len, runs)])[:-1]
    need = buckets.pause_for_one(10.0)
    got = buckets.decide(np.concatenate(runs), heads, np.full(50, 5), np.array([r[0] for r in runs]), need, 10.0, 5)
    assert list(zip(*[x.tolist() for x in got])) == [x for r in runs for x in walk(r, 10.0, 5)]


def table(spark, per_client):
    rows = [(c, t, k * 10_000 + i) for k, (c, ts) in enumerate(per_client.items()) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "client string, us bigint, event_id bigint")
    return df.select("client", F.timestamp_micros("us").alias("ts"), "event_id"), rows


@pytest.mark.parametrize("slices, together, rate, burst", [(7, 16, 10.0, 5), (40, 3, 1 / 600, 3)])
def test_one_client_with_all_rows_and_many_small_ones(spark, monkeypatch, slices, together, rate, burst):
    monkeypatch.setattr(buckets, "TOGETHER", together)
    rng = random.Random(slices)
    hot = {"hot": times(rng, 2500, 200_000)}
    many = {**hot, **{f"c{k}": times(rng, 30, 200_000) for k in range(20)}, None: times(rng, 300, 50_000)}
    for clients in (hot, many):
        df, rows = table(spark, clients)
        held = spark.createDataFrame([("hot", 1, clients["hot"][0] - 50_000), ("gone", 1, 5)], "client string, tokens_left bigint, mark_us bigint")
        for kept in (None, held):
            want = {}
            for k, (c, ts) in enumerate(clients.items()):
                state = (1, ts[0] - 50_000) if c == "hot" and kept is not None else None
                want.update({k * 10_000 + i: x for i, x in enumerate(walk(ts, rate, burst, state))})
            got = buckets.token_buckets(df, rate, burst, kept, slices).collect()
            assert {r.event_id: (r.allowed, r.tokens_left, r.mark_us) for r in got} == want and len(got) == len(rows)


def test_a_hot_client_spreads_over_the_slices(spark):
    df, rows = table(spark, {"hot": times(random.Random(1), 4000, 100_000)})
    out = requests.rate_limit(df, 10.0, 5, slices=12)
    assert out.count() == len(rows)
    used = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(used) >= 6 and max(r["count"] for r in used) < len(rows) / 3


def test_empty_table(spark):
    df, _ = table(spark, {})
    assert buckets.token_buckets(df, 1.0, 2).collect() == []
