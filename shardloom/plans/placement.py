"""Queries for the manifest, the hash ring and the shard assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.operators import epochs as ep
from shardloom.operators import manifest as mf
from shardloom.operators import ring as rg
from shardloom.operators.workers import rank_workers
from shardloom.plans.registry import query
from shardloom.plans.sql_views import FNV, with_views
from shardloom.session import small
from shardloom.sources import views
from shardloom.sources.tables import table

LEAVER = "worker-13"
NAMED_WORKER = "worker-5"


def ranked(spark, sf):
    return small(rank_workers(views.workers(spark, sf)))


def ring_of(spark, sf, without=None):
    workers = ranked(spark, sf)
    if without:
        workers = workers.filter(F.col("worker_id") != without)
    return rg.hash_ring(workers, inserted="rank")


def shards_of(spark, sf):
    return mf.shard_ranges(small(views.manifest(spark, sf)))


def plan_of(spark, sf, epochs=3, names=tuple(views.TABLES)):
    return ep.shard_assignment(views.manifest(spark, sf, names), ranked(spark, sf), epochs)


@query(
    "dataset_manifest",
    with_views("manifest_v", query="SELECT dataset_id, format, total_samples, shard_size, shuffle, seed, total_shards FROM manifest_v"),
)
def dataset_manifest(spark, sf):
    return views.manifest(spark, sf).drop("path")


@query(
    "dataset_listing",
    with_views(
        "manifest_v",
        query="SELECT dataset_id AS id, dataset_id AS name, total_samples, shard_size, total_shards AS shard_count, format, shuffle FROM manifest_v",
    ),
)
def dataset_listing(spark, sf):
    return mf.dataset_listing(views.manifest(spark, sf))


@query(
    "shard_ranges",
    with_views("shards_v", query="SELECT dataset_id, shard_id, total_shards, start_index, end_index, num_samples FROM shards_v"),
)
def shard_ranges(spark, sf):
    return shards_of(spark, sf)


@query(
    "state_snapshot",
    with_views(
        "manifest_v", "epoch_state_v",
        query="SELECT m.dataset_id, format, total_samples, shard_size, shuffle, seed, total_shards, current_epoch "
        "FROM manifest_v m JOIN epoch_state_v e ON m.dataset_id = e.dataset_id",
    ),
)
def state_snapshot(spark, sf):
    schema = (
        "current_epoch bigint, dataset_id string, format string, seed bigint, shard_size bigint, "
        "shuffle boolean, total_samples bigint, total_shards bigint"
    )
    return mf.restore(snapshot(spark, sf), "dataset", schema)


def snapshot(spark, sf):
    manifest = small(views.manifest(spark, sf).drop("path"))
    epochs = ep.epoch_state(views.epoch_log(spark, sf), manifest)
    return mf.state_snapshot(manifest, epochs, views.workers(spark, sf), ring_of(spark, sf))


@query("restored_workers", with_views("workers_v", query="SELECT worker_id, registered_at, gpu_count FROM workers_v"))
def restored_workers(spark, sf):
    return mf.restore(snapshot(spark, sf), "worker", "worker_id string, registered_at timestamp_ntz, gpu_count bigint")


@query("restored_ring", with_views("ring_v", query="SELECT worker_id, vnode, position FROM ring_v"))
def restored_ring(spark, sf):
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ring_of(spark, sf).schema)
    return mf.restore(snapshot(spark, sf), "ring", kinds).select("worker_id", "vnode", "position")


@query("hash_ring", with_views("ring_v", query="SELECT worker_id, vnode, position FROM ring_v"))
def hash_ring(spark, sf):
    return ring_of(spark, sf)


@query(
    "ring_lookup",
    with_views(
        "ring_v",
        query="SELECT doc_id, coalesce(r.worker_id, (SELECT min_by(worker_id, position) FROM ring_v)) AS worker_id "
        "FROM (SELECT doc_id, " + FNV.format("lang || '/' || doc_id") + " AS at FROM documents) d "
        "ASOF LEFT JOIN ring_v r ON d.at <= r.position",
    ),
)
def ring_lookup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    key = F.concat_ws("/", "lang", F.col("doc_id").cast("string"))
    return rg.ring_lookup(docs, ring_of(spark, sf), key).select("doc_id", "worker_id")


@query("ring_assignment", with_views("ring_assign_v", query="SELECT dataset_id, shard_id, worker_id FROM ring_assign_v"))
def ring_assignment(spark, sf):
    return rg.ring_assignment(shards_of(spark, sf), ring_of(spark, sf)).select("dataset_id", "shard_id", "worker_id")


@query(
    "shards_for_node",
    with_views(
        "ring_assign_v",
        query=f"SELECT dataset_id, shard_id, worker_id FROM ring_assign_v WHERE worker_id = '{NAMED_WORKER}'",
    ),
)
def shards_for_node(spark, sf):
    return rg.shards_for_node(ring_assignment(spark, sf), NAMED_WORKER)


@query(
    "place_rows_on_ring",
    with_views(
        "ring_v",
        query="SELECT worker_id, count(*) AS line_rows, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity FROM ("
        "SELECT l_quantity, coalesce(r.worker_id, (SELECT min_by(worker_id, position) FROM ring_v)) AS worker_id "
        "FROM lineitem l JOIN (SELECT k, " + FNV.format("'order:' || k") + " AS at FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem)) h "
        "ON l.l_orderkey = h.k ASOF LEFT JOIN ring_v r ON h.at <= r.position) GROUP BY worker_id",
    ),
)
def place_rows_on_ring(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    key = F.concat(F.lit("order:"), F.col("l_orderkey").cast("string"))
    placed = rg.place_rows_on_ring(lines, ring_of(spark, sf), key)
    return placed.groupBy("worker_id").agg(
        F.count(F.lit(1)).alias("line_rows"),
        F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double").alias("quantity"),
    )


RING_WITHOUT = "part_ring AS (SELECT * FROM ring_v WHERE worker_id <> '" + LEAVER + "'), part_assign AS (SELECT s.dataset_id, s.shard_id, " \
    "coalesce(r.worker_id, (SELECT min_by(worker_id, position) FROM part_ring)) AS worker_id FROM (SELECT *, " \
    + FNV.format("dataset_id || ':' || shard_id") + " AS at FROM shards_v) s ASOF LEFT JOIN part_ring r ON s.at <= r.position)"


def both_sides(spark, sf):
    shards = shards_of(spark, sf)
    part = rg.ring_assignment(shards, ring_of(spark, sf, without=LEAVER))
    return part, rg.ring_assignment(shards, ring_of(spark, sf))


@query(
    "ring_moves",
    with_views(
        "ring_assign_v", extra=RING_WITHOUT,
        query="SELECT c.change, a.dataset_id, a.shard_id, CASE WHEN c.change = 'join' THEN p.worker_id ELSE a.worker_id END AS from_worker, "
        "CASE WHEN c.change = 'join' THEN a.worker_id ELSE p.worker_id END AS to_worker FROM ring_assign_v a JOIN part_assign p "
        "ON a.dataset_id = p.dataset_id AND a.shard_id = p.shard_id, (VALUES ('join'), ('leave')) c(change) WHERE a.worker_id <> p.worker_id",
    ),
)
def ring_moves(spark, sf):
    without, with_all = both_sides(spark, sf)
    joins = rg.ring_moves(without, with_all).withColumn("change", F.lit("join"))
    return joins.unionByName(rg.ring_moves(with_all, without).withColumn("change", F.lit("leave")))


@query(
    "ring_net_loss",
    with_views(
        "ring_assign_v", extra=RING_WITHOUT,
        query="SELECT worker_id, CAST(sum(old) AS BIGINT) AS shards_before, CAST(sum(new) AS BIGINT) AS shards_after, "
        "CAST(greatest(sum(old) - sum(new), 0) AS BIGINT) AS net_loss FROM (SELECT worker_id, 1 AS old, 0 AS new FROM part_assign "
        "UNION ALL SELECT worker_id, 0, 1 FROM ring_assign_v) GROUP BY worker_id",
    ),
)
def ring_net_loss(spark, sf):
    without, with_all = both_sides(spark, sf)
    return rg.ring_net_loss(without, with_all)


@query(
    "ring_retention",
    with_views(
        "ring_assign_v", extra=RING_WITHOUT,
        query="SELECT a.worker_id, count(*) AS shards_before, count(*) FILTER (WHERE p.worker_id = a.worker_id) AS shards_kept, "
        "round(count(*) FILTER (WHERE p.worker_id = a.worker_id) / count(*), 6) AS kept_share FROM ring_assign_v a "
        "JOIN part_assign p ON a.dataset_id = p.dataset_id AND a.shard_id = p.shard_id "
        "WHERE a.worker_id IN (SELECT worker_id FROM part_assign) GROUP BY a.worker_id",
    ),
)
def ring_retention(spark, sf):
    without, with_all = both_sides(spark, sf)
    return rg.ring_retention(with_all, without)


@query(
    "ring_counts",
    with_views(
        "ring_assign_v",
        query="SELECT w.worker_id, count(a.shard_id) AS shards FROM ranked_v w LEFT JOIN ring_assign_v a ON w.worker_id = a.worker_id GROUP BY w.worker_id",
    ),
)
def ring_counts(spark, sf):
    return rg.ring_counts(ring_assignment(spark, sf), ranked(spark, sf))


@query(
    "ring_balance",
    with_views(
        "ring_assign_v",
        query="SELECT count(*) AS workers, CAST(sum(n) AS BIGINT) AS shards, round(avg(n), 6) AS mean_shards, round(stddev_pop(n), 6) AS stddev_shards, "
        "min(n) AS min_shards, max(n) AS max_shards, round(greatest(max(n) - avg(n), avg(n) - min(n)) / avg(n), 6) AS worst_deviation FROM "
        "(SELECT w.worker_id, count(a.shard_id) AS n FROM ranked_v w LEFT JOIN ring_assign_v a ON w.worker_id = a.worker_id GROUP BY w.worker_id)",
    ),
)
def ring_balance(spark, sf):
    return rg.ring_balance(ring_assignment(spark, sf), ranked(spark, sf))


@query("ring_members", with_views("ring_v", query="SELECT worker_id, count(*) AS points FROM ring_v GROUP BY worker_id"))
def ring_members(spark, sf):
    return rg.ring_members(ring_of(spark, sf))


@query("epoch_state", with_views("epoch_state_v", query="SELECT dataset_id, current_epoch FROM epoch_state_v"))
def epoch_state(spark, sf):
    return ep.epoch_state(views.epoch_log(spark, sf), small(views.manifest(spark, sf)))


@query("epoch_shard_order", with_views("order_v", query="SELECT dataset_id, epoch, shard_id, order_index FROM order_v"))
def epoch_shard_order(spark, sf):
    manifest = small(views.manifest(spark, sf))
    order = ep.epoch_shard_order(ep.with_epochs(mf.shard_ranges(manifest), 3), manifest)
    return order.select("dataset_id", "epoch", "shard_id", "order_index")


@query(
    "round_robin_assignment",
    with_views(
        "order_v", "ranked_v",
        query="SELECT dataset_id, epoch, shard_id, order_index, worker_id FROM order_v JOIN ranked_v "
        "ON order_index % (SELECT count(*) FROM ranked_v) = rank",
    ),
)
def round_robin_assignment(spark, sf):
    manifest = small(views.manifest(spark, sf))
    order = ep.epoch_shard_order(ep.with_epochs(mf.shard_ranges(manifest), 3), manifest)
    turns = ep.round_robin_assignment(order, ranked(spark, sf))
    return turns.select("dataset_id", "epoch", "shard_id", "order_index", "worker_id")


@query(
    "shard_assignment",
    with_views(
        "assignment_v",
        query="SELECT dataset_id, epoch, shard_id, worker_id, order_index, total_shards, start_index, end_index, num_samples FROM assignment_v",
    ),
)
def shard_assignment(spark, sf):
    return plan_of(spark, sf)


@query(
    "first_shard",
    with_views(
        "assignment_v",
        query="SELECT dataset_id, epoch, worker_id, order_index, shard_id, total_shards, start_index, end_index, num_samples FROM "
        "(SELECT *, row_number() OVER (PARTITION BY dataset_id, epoch, worker_id ORDER BY order_index, shard_id) AS n FROM assignment_v) WHERE n = 1",
    ),
)
def first_shard(spark, sf):
    return ep.first_shard(plan_of(spark, sf))


@query(
    "rebalance",
    with_views(
        "epoch_state_v", "ring_assign_v", "ranked_v",
        query="SELECT worker_id, o.dataset_id, o.current_epoch AS epoch, shard_id FROM (SELECT s.dataset_id, s.shard_id, e.current_epoch, "
        "row_number() OVER (PARTITION BY s.dataset_id ORDER BY md5(concat_ws('|', seed, s.dataset_id, e.current_epoch, shard_id)), shard_id) - 1 AS n "
        "FROM shards_v s JOIN epoch_state_v e ON s.dataset_id = e.dataset_id WHERE s.shuffle) o "
        "JOIN ranked_v w ON o.n % (SELECT count(*) FROM ranked_v) = w.rank "
        "UNION ALL SELECT a.worker_id, a.dataset_id, e.current_epoch, a.shard_id FROM ring_assign_v a "
        "JOIN epoch_state_v e ON a.dataset_id = e.dataset_id WHERE NOT a.shuffle",
    ),
)
def rebalance(spark, sf):
    return ep.rebalance(views.manifest(spark, sf), ranked(spark, sf), views.epoch_log(spark, sf))


@query(
    "assignment_audit",
    with_views(
        "assignment_v",
        query="SELECT dataset_id, epoch, count(num_samples) AS shards, count(*) FILTER (WHERE times IS NULL) AS missing_shards, "
        "count(*) FILTER (WHERE times > 1) AS repeated_shards, count(*) FILTER (WHERE num_samples IS NULL) AS unknown_shards, "
        "CAST(coalesce(sum(num_samples) FILTER (WHERE times > 0), 0) AS BIGINT) AS covered_samples FROM "
        "(SELECT dataset_id, epoch, shard_id, s.num_samples, a.times FROM (SELECT s.dataset_id, e.epoch, s.shard_id, s.num_samples "
        "FROM shards_v s JOIN epochs_v e ON s.dataset_id = e.dataset_id) s FULL JOIN (SELECT dataset_id, epoch, shard_id, count(*) AS times "
        "FROM assignment_v GROUP BY ALL) a USING (dataset_id, epoch, shard_id)) GROUP BY dataset_id, epoch",
    ),
)
def assignment_audit(spark, sf):
    return ep.assignment_audit(small(views.manifest(spark, sf)), plan_of(spark, sf))


@query(
    "multi_epoch_plan",
    with_views(
        "assignment_v",
        query="SELECT dataset_id, epoch, worker_id, count(*) AS shards, CAST(sum(num_samples) AS BIGINT) AS samples FROM assignment_v GROUP BY ALL",
    ),
)
def multi_epoch_plan(spark, sf):
    return ep.multi_epoch_load(plan_of(spark, sf))


@query(
    "capacity_assignment",
    with_views(
        "manifest_v", "workers_v",
        query="SELECT dataset_id, worker_id, gpu_count AS weight, whole + CASE WHEN n <= total_shards - placed THEN 1 ELSE 0 END AS shards FROM "
        "(SELECT *, CAST(sum(whole) OVER (PARTITION BY dataset_id) AS BIGINT) AS placed, "
        "row_number() OVER (PARTITION BY dataset_id ORDER BY rest DESC, worker_id) AS n FROM "
        "(SELECT m.dataset_id, m.total_shards, w.worker_id, w.gpu_count, CAST(m.total_shards * w.gpu_count // c AS BIGINT) AS whole, "
        "m.total_shards * w.gpu_count % c AS rest FROM manifest_v m, workers_v w, (SELECT CAST(sum(gpu_count) AS BIGINT) AS c FROM workers_v)))",
    ),
)
def capacity_assignment(spark, sf):
    return ep.capacity_assignment(small(views.manifest(spark, sf)), views.workers(spark, sf))
