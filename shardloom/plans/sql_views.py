"""The derived views again as SQL common table expressions for the oracle."""

from __future__ import annotations

from shardloom.sources import views as v


def _case(column: str, values: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in values.items()) + f" ELSE {default} END"


K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
FNV = (
    "CAST(list_reduce(list_concat([14695981039346656037::HUGEINT], "
    "list_concat(list_transform(string_split({0}, ''), lambda c: ascii(c)::HUGEINT), [255::HUGEINT])), "
    "lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) "
    "- 9223372036854775808::HUGEINT AS BIGINT)"
)

VIEWS: dict[str, tuple[list[str], str]] = {
    "manifest_v": (
        [],
        " UNION ALL ".join(
            f"SELECT '{t}' AS dataset_id, 'parquet' AS format, count(*) AS total_samples, "
            f"CAST({v.SHARD_SIZES.get(t, v.DEFAULT_SHARD_SIZE)} AS BIGINT) AS shard_size, "
            f"{str(t in v.SHUFFLED).upper()} AS shuffle, CAST({v.SEED} AS BIGINT) AS seed, "
            f"CAST(ceil(count(*) / {v.SHARD_SIZES.get(t, v.DEFAULT_SHARD_SIZE)}) AS BIGINT) AS total_shards FROM {t}"
            for t in v.TABLES
        ),
    ),
    "shards_v": (
        ["manifest_v"],
        "SELECT dataset_id, shuffle, seed, total_shards, i AS shard_id, i * shard_size AS start_index, "
        "least((i + 1) * shard_size, total_samples) AS end_index, "
        "least((i + 1) * shard_size, total_samples) - i * shard_size AS num_samples "
        "FROM (SELECT *, unnest(range(total_shards)) AS i FROM manifest_v)",
    ),
    "workers_v": (
        [],
        f"SELECT 'worker-' || (user_id % {v.WORKERS}) AS worker_id, min(ts) AS registered_at, "
        f"CAST(4 + 4 * ((user_id % {v.WORKERS}) % 2) AS BIGINT) AS gpu_count "
        f"FROM events GROUP BY user_id % {v.WORKERS}",
    ),
    "ranked_v": (
        ["workers_v"],
        "SELECT *, row_number() OVER (ORDER BY registered_at, worker_id) - 1 AS rank FROM workers_v",
    ),
    "epoch_log_v": (
        [],
        "SELECT ['lineitem', 'orders', 'documents', 'unregistered'][event_id % 4 + 1] AS dataset_id, "
        "CASE event_type WHEN 'signup' THEN 'init' ELSE 'advance' END AS op, "
        f"{K} % 5 AS epoch, ts, event_id FROM events WHERE event_type IN ('signup', 'click')",
    ),
    "epoch_state_v": (
        ["epoch_log_v", "manifest_v"],
        "SELECT m.dataset_id, CAST(coalesce((SELECT l.epoch FROM epoch_log_v l WHERE l.dataset_id = m.dataset_id "
        "AND l.op = 'init' ORDER BY ts DESC, event_id DESC LIMIT 1), 0) + (SELECT count(*) FROM epoch_log_v a "
        "WHERE a.dataset_id = m.dataset_id AND a.op = 'advance' AND NOT EXISTS (SELECT 1 FROM epoch_log_v i "
        "WHERE i.dataset_id = a.dataset_id AND i.op = 'init' AND (i.ts > a.ts OR (i.ts = a.ts AND i.event_id > a.event_id)))) "
        "AS BIGINT) AS current_epoch FROM manifest_v m",
    ),
    "epochs_v": (["manifest_v"], "SELECT dataset_id, unnest(range(3)) AS epoch FROM manifest_v"),
    "order_v": (
        ["shards_v", "epochs_v"],
        "SELECT s.*, e.epoch, row_number() OVER (PARTITION BY s.dataset_id, e.epoch ORDER BY "
        "md5(concat_ws('|', seed, s.dataset_id, e.epoch, shard_id)), shard_id) - 1 AS order_index "
        "FROM shards_v s JOIN epochs_v e ON s.dataset_id = e.dataset_id",
    ),
    "ring_v": (
        ["ranked_v"],
        "SELECT worker_id, vnode, position FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY rank DESC, vnode DESC) AS keep "
        "FROM (SELECT worker_id, rank, vnode, " + FNV.format("worker_id || ':' || vnode") + " AS position "
        "FROM (SELECT worker_id, rank, unnest(range(150)) AS vnode FROM ranked_v))) WHERE keep = 1",
    ),
    "ring_assign_v": (
        ["shards_v", "ring_v"],
        "SELECT s.*, coalesce(r.worker_id, (SELECT min_by(worker_id, position) FROM ring_v)) AS worker_id "
        "FROM (SELECT *, " + FNV.format("dataset_id || ':' || shard_id") + " AS at FROM shards_v) s "
        "ASOF LEFT JOIN ring_v r ON s.at <= r.position",
    ),
    "assignment_v": (
        ["order_v", "ring_assign_v", "epochs_v"],
        "SELECT o.dataset_id, o.epoch, o.shard_id, w.worker_id, o.order_index, o.total_shards, o.start_index, o.end_index, o.num_samples "
        "FROM order_v o JOIN ranked_v w ON o.order_index % (SELECT count(*) FROM ranked_v) = w.rank WHERE o.shuffle "
        "UNION ALL SELECT r.dataset_id, e.epoch, r.shard_id, r.worker_id, r.shard_id, r.total_shards, r.start_index, r.end_index, r.num_samples "
        "FROM ring_assign_v r JOIN epochs_v e ON r.dataset_id = e.dataset_id WHERE NOT r.shuffle",
    ),
    "indexed_lineitem_v": (
        [],
        f"SELECT *, row_number() OVER (ORDER BY {', '.join(v.LINEITEM_ORDER)}) - 1 AS sample_idx FROM lineitem",
    ),
    "heartbeats_v": (
        [],
        f"SELECT event_id, ts, 'worker-' || (user_id % {v.WORKERS}) AS worker_id, "
        f"{_case('event_type', v.STATES)} AS state, {K} AS current_step, CAST(day(ts) AS BIGINT) AS current_epoch, "
        f"{_case('event_type', v.ACTIONS)} || '_' || {v.SYMBOLS!r}[{K} % 4 + 1] || '_epoch' || day(ts) AS current_task, "
        "least(100.0::DOUBLE, value / 5) AS cpu_percent, event_id * 1024 AS memory_used_bytes FROM events",
    ),
    "latest_v": (
        ["heartbeats_v"],
        "SELECT * EXCLUDE (newest) FROM (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY ts DESC, event_id DESC) AS newest "
        "FROM heartbeats_v) WHERE newest = 1",
    ),
    "arrivals_v": (
        [],
        f"SELECT 'epoch-' || ({K} % 10) AS barrier_id, 'worker-' || (user_id % {v.WORKERS}) AS worker_id, ts, event_id FROM events",
    ),
    "generations_v": (
        ["arrivals_v"],
        "SELECT *, n // 16 AS generation, n % 16 + 1 AS arrival_order, (n // 16 + 1) * 16 <= total AS released "
        "FROM (SELECT *, row_number() OVER (PARTITION BY barrier_id ORDER BY ts, event_id) - 1 AS n, "
        "count(*) OVER (PARTITION BY barrier_id) AS total FROM arrivals_v)",
    ),
    "checkpoints_v": (
        [],
        "SELECT 'ckpt-' || o_orderkey AS checkpoint_id, o_orderkey % 500 AS step, CAST(year(o_orderdate) - 1995 AS BIGINT) AS epoch, "
        f"'worker-' || (o_custkey % {v.WORKERS}) AS worker_id, '/ckpt/' || o_orderkey AS path, "
        "CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes, o_orderdate AS notified_at, o_orderkey AS notification, "
        "o_orderpriority AS priority FROM orders",
    ),
    "catalogue_v": (
        ["checkpoints_v"],
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY notified_at DESC, notification DESC) AS newest, "
        "count(*) OVER (PARTITION BY step) - 1 AS overwritten FROM checkpoints_v) WHERE newest = 1",
    ),
    "write_events_v": (
        [],
        f"SELECT 'ckpt-' || user_id AS checkpoint_id, {_case('event_type', v.WRITE_STATES)} AS status, "
        "CASE event_type WHEN 'error' THEN props END AS error, ts, event_id FROM events",
    ),
    "requests_v": (
        [],
        "SELECT event_id, user_id AS client, event_type AS method, CAST(round(value * 1000) AS BIGINT) AS latency_us, "
        "value >= 200 AS is_error, ts FROM events",
    ),
    "tasks_v": (
        [],
        "SELECT 'task_' || o_orderkey AS task_id, o_orderkey, o_orderpriority AS name, o_orderdate AS started_at, "
        "CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' END AS status, "
        "1 + o_orderkey % 4 AS worker_count FROM orders",
    ),
    "logs_v": (
        [],
        f"SELECT event_id AS log_id, ts AS time, {_case('event_type', v.LEVELS, chr(39) + 'info' + chr(39))} AS level, "
        "event_type AS source, props AS message FROM events",
    ),
    "steps_v": (
        [],
        "SELECT user_id AS run, ts, event_id, CAST(value AS DECIMAL(12,2)) AS loss, "
        f"CAST({K} >= 50 AS BIGINT) AS correct, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events",
    ),
}


def with_views(*names: str, query: str, extra: str = "", recursive: bool = False) -> str:
    """``query`` behind the WITH list of the named views and what they need."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS[name][0]:
            add(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in needed]
    if extra:
        parts.append(extra)
    if not parts:
        return query
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + " " + query
