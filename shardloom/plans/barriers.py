"""Queries over barrier arrivals."""

from __future__ import annotations

from shardloom.operators import barriers as br
from shardloom.plans.registry import query
from shardloom.plans.sql_views import with_views
from shardloom.plans.workers import AS_OF_SQL
from shardloom.sources import views

EXPECTED = views.WORKERS
WAITS = (
    "waits AS (SELECT *, CASE WHEN released THEN (epoch_us(max(ts) OVER (PARTITION BY barrier_id, generation)) - epoch_us(ts)) / 1000000 END AS wait_s, "
    "CASE WHEN released THEN max(ts) OVER (PARTITION BY barrier_id, generation) END AS released_at FROM generations_v)"
)


def arrived(spark, sf):
    return br.barrier_arrivals(views.arrivals(spark, sf), EXPECTED)


@query(
    "barrier_arrivals",
    with_views(
        "generations_v",
        query="SELECT barrier_id, worker_id, ts, event_id, generation, arrival_order, released, CASE WHEN released THEN 16::BIGINT END AS participants FROM generations_v",
    ),
)
def barrier_arrivals(spark, sf):
    return arrived(spark, sf)


@query(
    "barrier_arrivals_dedup",
    with_views(
        "arrivals_v",
        query="SELECT barrier_id, worker_id, ts, event_id, row_number() OVER (PARTITION BY barrier_id ORDER BY ts, event_id) AS arrival_order, "
        "count(*) OVER (PARTITION BY barrier_id) >= 16 AS complete FROM (SELECT *, row_number() OVER (PARTITION BY barrier_id, worker_id "
        "ORDER BY ts, event_id) AS n FROM arrivals_v) WHERE n = 1",
    ),
)
def barrier_arrivals_dedup(spark, sf):
    return br.barrier_arrivals_dedup(views.arrivals(spark, sf), EXPECTED)


@query(
    "barrier_status",
    with_views(
        "generations_v",
        query="SELECT barrier_id, generation, count(*) AS arrived, 16::BIGINT AS total, CASE WHEN count(*) >= 16 THEN 'complete' ELSE 'waiting' END AS status, "
        "round(count(*) * 100 / 16, 4) AS percent FROM generations_v GROUP BY 1, 2",
    ),
)
def barrier_status(spark, sf):
    return br.barrier_status(arrived(spark, sf), EXPECTED)


@query(
    "barrier_wait",
    with_views("generations_v", extra=WAITS, query="SELECT barrier_id, generation, worker_id, event_id, released_at, wait_s FROM waits WHERE released"),
)
def barrier_wait(spark, sf):
    waits = br.barrier_wait(arrived(spark, sf)).filter("released")
    return waits.select("barrier_id", "generation", "worker_id", "event_id", "released_at", "wait_s")


@query(
    "barrier_wait_p99",
    with_views(
        "generations_v", extra=WAITS,
        query="SELECT barrier_id, n AS samples, wait_s AS p99_wait_s FROM (SELECT barrier_id, wait_s, row_number() OVER "
        "(PARTITION BY barrier_id ORDER BY wait_s, event_id) - 1 AS p, count(*) OVER (PARTITION BY barrier_id) AS n FROM waits WHERE released) "
        "WHERE p = least(CAST(floor(n * 0.99::DOUBLE) AS BIGINT), n - 1)",
    ),
)
def barrier_wait_p99(spark, sf):
    return br.barrier_wait_p99(br.barrier_wait(arrived(spark, sf)))


@query(
    "barrier_timeouts",
    with_views(
        "generations_v", extra=WAITS,
        query="SELECT barrier_id, generation, worker_id, event_id, released, (epoch_us(coalesce(released_at, "
        f"{AS_OF_SQL})) - epoch_us(ts)) / 1000000 AS wait_s FROM waits WHERE (epoch_us(coalesce(released_at, {AS_OF_SQL})) - epoch_us(ts)) / 1000000 > 300",
    ),
)
def barrier_timeouts(spark, sf):
    late = br.barrier_timeouts(br.barrier_wait(arrived(spark, sf)), views.as_of())
    return late.select("barrier_id", "generation", "worker_id", "event_id", "released", "wait_s")
