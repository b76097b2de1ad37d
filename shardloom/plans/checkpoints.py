"""Queries over checkpoints: catalogue, retention, recovery, writes, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions.display import format_bytes, format_number
from shardloom.operators import adaptive, versions
from shardloom.operators import checkpoints as ck
from shardloom.operators.delivery import shard_samples
from shardloom.operators.training import numbered_steps
from shardloom.plans.placement import ranked
from shardloom.plans.registry import query
from shardloom.plans.sql_views import with_views
from shardloom.session import work_folder
from shardloom.sources import containers, views
from shardloom.sources.objects import catalogue_vs_files as compare_files
from shardloom.sources.objects import object_inventory as inventory
from shardloom.sources.tables import table

WORKER = "worker-5"


def catalogue(spark, sf):
    return ck.checkpoint_catalogue(views.checkpoints(spark, sf))


@query(
    "validate_checkpoints",
    with_views(
        "checkpoints_v",
        query="SELECT checkpoint_id, worker_id, step, size_bytes, CASE WHEN worker_id = '' THEN 'worker_id_empty' WHEN checkpoint_id = '' THEN "
        "'checkpoint_id_empty' WHEN step < 0 THEN 'step_negative' WHEN size_bytes < 0 THEN 'size_negative' END AS reason FROM "
        "(SELECT CASE WHEN notification % 17 = 0 THEN '' ELSE checkpoint_id END AS checkpoint_id, CASE WHEN notification % 13 = 0 THEN '' ELSE worker_id END AS worker_id, "
        "step - 3 AS step, size_bytes - 1500000 AS size_bytes FROM checkpoints_v)",
    ),
)
def validate_checkpoints(spark, sf):
    # The given orders are all valid notifications, so some are spoiled here.
    n = F.col("notification")
    spoiled = views.checkpoints(spark, sf).select(
        F.when(n % 17 == 0, "").otherwise(F.col("checkpoint_id")).alias("checkpoint_id"),
        F.when(n % 13 == 0, "").otherwise(F.col("worker_id")).alias("worker_id"),
        (F.col("step") - 3).alias("step"),
        (F.col("size_bytes") - 1_500_000).alias("size_bytes"),
    )
    return ck.validate_checkpoints(spoiled)


@query(
    "checkpoint_catalogue",
    with_views(
        "catalogue_v",
        query="SELECT step, checkpoint_id, epoch, worker_id AS meta_worker, priority AS meta_priority, path, size_bytes, notified_at, overwritten FROM catalogue_v",
    ),
)
def checkpoint_catalogue(spark, sf):
    return catalogue(spark, sf).select(
        "step", "checkpoint_id", "epoch",
        F.col("metadata")["worker_id"].alias("meta_worker"),
        F.col("metadata")["priority"].alias("meta_priority"),
        "path", "size_bytes", "notified_at", "overwritten",
    )


@query(
    "checkpoint_catalogue_by_worker",
    with_views(
        "checkpoints_v",
        query="SELECT worker_id, step, checkpoint_id, n - 1 AS overwritten FROM (SELECT *, row_number() OVER (PARTITION BY worker_id, step "
        "ORDER BY notified_at DESC, notification DESC) AS newest, count(*) OVER (PARTITION BY worker_id, step) AS n FROM checkpoints_v) WHERE newest = 1",
    ),
)
def checkpoint_catalogue_by_worker(spark, sf):
    notices = views.checkpoints(spark, sf).withColumn("run", F.col("worker_id"))
    kept = ck.checkpoint_catalogue(notices, key=("run", "step"))
    return kept.select(F.col("run").alias("worker_id"), "step", "checkpoint_id", "overwritten")


@query("retain_checkpoints", with_views("catalogue_v", query="SELECT step, checkpoint_id, path FROM catalogue_v ORDER BY step DESC LIMIT 5"))
def retain_checkpoints(spark, sf):
    return ck.retain_checkpoints(catalogue(spark, sf)).select("step", "checkpoint_id", "path")


@query(
    "eviction_plan",
    with_views("catalogue_v", query="SELECT step, checkpoint_id, path FROM catalogue_v WHERE step NOT IN (SELECT step FROM catalogue_v ORDER BY step DESC LIMIT 5)"),
)
def eviction_plan(spark, sf):
    return ck.eviction_plan(catalogue(spark, sf)).select("step", "checkpoint_id", "path")


@query("latest_checkpoint", with_views("catalogue_v", query="SELECT step, epoch, checkpoint_id FROM catalogue_v ORDER BY step DESC LIMIT 1"))
def latest_checkpoint(spark, sf):
    return ck.latest_checkpoint(catalogue(spark, sf)).select("step", "epoch", "checkpoint_id")


@query("checkpoint_by_step", with_views("catalogue_v", query="SELECT step, epoch, checkpoint_id, worker_id FROM catalogue_v WHERE step = 100"))
def checkpoint_by_step(spark, sf):
    return ck.checkpoint_by_step(catalogue(spark, sf), 100).select("step", "epoch", "checkpoint_id", "worker_id")


@query(
    "list_checkpoints",
    with_views(
        "catalogue_v",
        query="SELECT checkpoint_id AS id, step, epoch, size_bytes AS size, path, worker_id, 'completed' AS status FROM catalogue_v ORDER BY step LIMIT 20",
    ),
)
def list_checkpoints(spark, sf):
    return ck.list_checkpoints(catalogue(spark, sf))


@query(
    "recovery_plan",
    with_views(
        "catalogue_v", "ring_assign_v", "ranked_v",
        extra="point AS (SELECT checkpoint_id, step, epoch, path, size_bytes, worker_id FROM catalogue_v ORDER BY step DESC LIMIT 1), "
        "plan AS (SELECT o.dataset_id, shard_id, total_shards, start_index, end_index FROM (SELECT s.*, row_number() OVER (PARTITION BY dataset_id "
        "ORDER BY md5(concat_ws('|', seed, dataset_id, (SELECT epoch FROM point), shard_id)), shard_id) - 1 AS n FROM shards_v s WHERE shuffle) o "
        f"JOIN ranked_v w ON o.n % (SELECT count(*) FROM ranked_v) = w.rank WHERE w.worker_id = '{WORKER}' "
        f"UNION ALL SELECT dataset_id, shard_id, total_shards, start_index, end_index FROM ring_assign_v WHERE NOT shuffle AND worker_id = '{WORKER}')",
        query="SELECT TRUE AS has_checkpoint, checkpoint_id, step AS resume_step, epoch AS resume_epoch, path AS checkpoint_path, size_bytes AS checkpoint_bytes, "
        "worker_id AS written_by, dataset_id, shard_id, total_shards, start_index, end_index, dataset_id || '.parquet' AS dataset_file FROM point LEFT JOIN plan ON TRUE",
    ),
)
def recovery_plan(spark, sf):
    plan = ck.recovery_plan(catalogue(spark, sf), views.manifest(spark, sf), ranked(spark, sf), WORKER)
    # Folders differ between machines, so the answer shows the last part of the path.
    plan = plan.withColumn("dataset_file", F.substring_index("dataset_path", "/", -1))
    return plan.withColumn("written_by", F.try_element_at("metadata", F.lit("worker_id"))).drop("metadata", "dataset_path")


STATUS = (
    "folded AS (SELECT checkpoint_id, status, error, ts, known FROM (SELECT *, row_number() OVER (PARTITION BY checkpoint_id ORDER BY ts DESC, event_id DESC) AS n, "
    "bool_or(status = 'Pending') OVER (PARTITION BY checkpoint_id) AS known FROM write_events_v) WHERE n = 1)"
)


def status(spark, sf):
    return ck.known_writes(ck.write_status(views.write_events(spark, sf)))


@query("write_status", with_views("write_events_v", extra=STATUS, query="SELECT checkpoint_id, status, error, ts FROM folded WHERE known"))
def write_status(spark, sf):
    return status(spark, sf)


@query(
    "unknown_writes",
    with_views(
        "write_events_v",
        query="SELECT checkpoint_id, status FROM (SELECT *, row_number() OVER (PARTITION BY checkpoint_id ORDER BY ts DESC, event_id DESC) AS n FROM "
        "(SELECT *, count(*) FILTER (WHERE status = 'Pending') OVER (PARTITION BY checkpoint_id ORDER BY ts, event_id) AS starts FROM write_events_v) WHERE starts = 0) WHERE n = 1",
    ),
)
def unknown_writes(spark, sf):
    return ck.unknown_writes(views.write_events(spark, sf))


@query(
    "pending_summary",
    with_views(
        "write_events_v", extra=STATUS,
        query="SELECT count(*) FILTER (WHERE status IN ('Pending', 'InProgress')) AS open, count(*) FILTER (WHERE status = 'Completed') AS completed, "
        "count(*) FILTER (WHERE status = 'Failed') AS failed FROM folded WHERE known",
    ),
)
def pending_summary(spark, sf):
    return ck.pending_summary(status(spark, sf))


@query(
    "pending_failures",
    with_views("write_events_v", extra=STATUS, query="SELECT checkpoint_id, checkpoint_id || ': ' || error AS message FROM folded WHERE known AND status = 'Failed'"),
)
def pending_failures(spark, sf):
    return ck.pending_failures(status(spark, sf))


@query(
    "checkpoint_throughput",
    with_views(
        query="SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, count(*) AS checkpoints, CAST(sum(1000 + event_id % 4096) AS BIGINT) AS bytes, "
        "sum(1000 + event_id % 4096) / 60 AS bytes_per_s FROM events GROUP BY 1",
    ),
)
def checkpoint_throughput(spark, sf):
    # Every event as a notice: their times fall all over the minutes.
    notices = table(spark, sf, "events").select(F.col("ts").alias("notified_at"), (1000 + F.col("event_id") % 4096).alias("size_bytes"))
    return ck.checkpoint_throughput(notices)


def steps(spark, sf):
    return numbered_steps(views.runs(spark, sf))


@query("due_by_steps", with_views("steps_v", query="SELECT run, step, event_id FROM steps_v WHERE step > 0 AND step % 10 = 0"))
def due_by_steps(spark, sf):
    return ck.due_by_steps(steps(spark, sf), 10).select("run", "step", "event_id")


@query(
    "due_by_time",
    with_views(
        "steps_v",
        query="SELECT run, bucket, ts, event_id FROM (SELECT run, ts, event_id, time_bucket(INTERVAL '1 day', ts) AS bucket, "
        "row_number() OVER (PARTITION BY run, time_bucket(INTERVAL '1 day', ts) ORDER BY ts, event_id) AS n FROM steps_v) WHERE n = 1",
    ),
)
def due_by_time(spark, sf):
    return ck.due_by_time(views.runs(spark, sf), "1 day")


@query(
    "due_adaptive",
    with_views(
        "steps_v", recursive=True,
        extra="walk AS (SELECT run, step, CAST(loss AS DOUBLE) AS loss, step AS saved_step, CAST(loss AS DOUBLE) AS saved_loss, FALSE AS due FROM steps_v WHERE step = 0 "
        "UNION ALL SELECT s.run, s.step, CAST(s.loss AS DOUBLE), CASE WHEN d.due THEN s.step ELSE w.saved_step END, CASE WHEN d.due THEN CAST(s.loss AS DOUBLE) ELSE w.saved_loss END, d.due "
        "FROM walk w JOIN steps_v s ON s.run = w.run AND s.step = w.step + 1, LATERAL (SELECT s.step - w.saved_step >= 12 OR (s.step - w.saved_step >= 3 AND "
        "w.saved_loss - CAST(s.loss AS DOUBLE) >= 20.0::DOUBLE) AS due) d)",
        query="SELECT run, step, loss FROM walk WHERE due",
    ),
)
def due_adaptive(spark, sf):
    return adaptive.due_adaptive(steps(spark, sf), min_steps=3, max_steps=12, loss_threshold=20.0)


@query(
    "best_checkpoint",
    with_views(
        "steps_v",
        query="SELECT run, event_id, ts, accuracy FROM (SELECT run, event_id, ts, CAST(loss AS DOUBLE) / 500 AS accuracy, max(CAST(loss AS DOUBLE) / 500) OVER "
        "(PARTITION BY run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM steps_v) WHERE accuracy > coalesce(best, 0)",
    ),
)
def best_checkpoint(spark, sf):
    metrics = views.runs(spark, sf).select("run", "event_id", "ts", (F.col("loss").cast("double") / 500).alias("accuracy"))
    return ck.best_checkpoint(metrics)


NEW_CUSTOMER = (
    "new_customer AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal + CASE WHEN c_custkey % 10 = 1 THEN 1 ELSE 0 END AS c_acctbal, c_mktsegment "
    "FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey + 1000000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 50 = 2)"
)


def altered_customer(spark, sf):
    """The second version: some rows gone, some changed, some new."""
    base = table(spark, sf, "customer")
    key = F.col("c_custkey")
    kept = base.filter(key % 10 != 0).withColumn("c_acctbal", F.col("c_acctbal") + F.when(key % 10 == 1, 1.0).otherwise(0.0))
    return base, kept.unionByName(base.filter(key % 50 == 2).withColumn("c_custkey", key + 1_000_000_000))


DELTA_SQL = (
    "SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'insert' WHEN n.c_custkey IS NULL THEN 'delete' "
    "ELSE 'update' END AS op, n.c_name, n.c_nationkey, n.c_acctbal, n.c_mktsegment FROM customer o FULL JOIN new_customer n ON o.c_custkey = n.c_custkey "
    "WHERE (o.c_name, o.c_nationkey, o.c_acctbal, o.c_mktsegment) IS DISTINCT FROM (n.c_name, n.c_nationkey, n.c_acctbal, n.c_mktsegment) "
    "OR o.c_custkey IS NULL OR n.c_custkey IS NULL"
)


@query("table_delta", with_views(extra=NEW_CUSTOMER, query=DELTA_SQL))
def table_delta(spark, sf):
    base, new = altered_customer(spark, sf)
    return ck.table_delta(base, new, ["c_custkey"])


@query("apply_delta", with_views(extra=NEW_CUSTOMER, query="SELECT * FROM new_customer"))
def apply_delta(spark, sf):
    base, new = altered_customer(spark, sf)
    return ck.apply_delta(base, ck.table_delta(base, new, ["c_custkey"]), ["c_custkey"])


FEW_CHANGED = (
    "new_customer AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal + CASE WHEN c_custkey % 500 = 1 THEN 1 ELSE 0 END AS c_acctbal, c_mktsegment "
    "FROM customer WHERE c_custkey % 500 <> 0 UNION ALL SELECT c_custkey + 1000000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 500 = 2)"
)


@query("version_delta", with_views(extra=FEW_CHANGED, query=DELTA_SQL))
def version_delta(spark, sf):
    base = table(spark, sf, "customer")
    key = F.col("c_custkey")
    kept = base.filter(key % 500 != 0).withColumn("c_acctbal", F.col("c_acctbal") + F.when(key % 500 == 1, 1.0).otherwise(0.0))
    new = kept.unionByName(base.filter(key % 500 == 2).withColumn("c_custkey", key + 1_000_000_000))
    old, fresh = work_folder(spark, "customer-old"), work_folder(spark, "customer-new")
    versions.write_version(base, ["c_custkey"], old, bits=12)
    versions.write_version(new, ["c_custkey"], fresh, like=old)
    return versions.version_delta(spark, old, fresh, ["c_custkey"])


@query(
    "checkpoint_sizes",
    with_views(
        "checkpoints_v",
        query="SELECT worker_id, epoch, count(*) AS checkpoints, CAST(sum(size_bytes) AS BIGINT) AS bytes, max(size_bytes) AS largest, "
        "grouping(worker_id, epoch) AS level FROM checkpoints_v GROUP BY ROLLUP (worker_id, epoch)",
    ),
)
def checkpoint_sizes(spark, sf):
    return ck.checkpoint_sizes(views.checkpoints(spark, sf))


def size_text(n, unit, power):
    tenths = f"(({n} * 20 + {unit}) // {2 * unit})" if power else f"({n} * 10)"
    return f"({tenths} // 10) || CASE WHEN {tenths} % 10 <> 0 THEN '.' || ({tenths} % 10) ELSE '' END"


@query(
    "checkpoint_report",
    with_views(
        "checkpoints_v",
        query="SELECT worker_id, n AS checkpoints, CASE "
        + " ".join(f"WHEN b >= {1024**p} THEN {size_text('b', 1024**p, p)} || ' {u}'" for p, u in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB"), (0, "B")))
        + " ELSE '0 B' END AS total_size, CASE WHEN b >= 1000000 THEN ((b * 20 + 1000000) // 2000000 // 10) || '.' || ((b * 20 + 1000000) // 2000000 % 10) || 'M' "
        "WHEN b >= 1000 THEN ((b * 20 + 1000) // 2000 // 10) || '.' || ((b * 20 + 1000) // 2000 % 10) || 'K' ELSE CAST(b AS VARCHAR) END AS total_number "
        "FROM (SELECT worker_id, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS b FROM checkpoints_v GROUP BY 1)",
    ),
)
def checkpoint_report(spark, sf):
    sizes = views.checkpoints(spark, sf).groupBy("worker_id").agg(
        F.count(F.lit(1)).alias("checkpoints"), F.sum("size_bytes").alias("bytes")
    )
    return sizes.select(
        "worker_id", "checkpoints",
        format_bytes(F.col("bytes")).alias("total_size"),
        format_number(F.col("bytes")).alias("total_number"),
    )


def document_containers(spark, sf):
    """One container per shard of the documents, holding its texts."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    shards = shard_samples(docs, ["doc_id"], views.SHARD_SIZES["documents"])
    # A shard has a fixed number of rows, which bounds this list.
    texts = F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "text"))), lambda s: s["text"])
    joined = shards.groupBy("shard_id").agg(F.encode(F.array_join(texts, ""), "UTF-8").alias("data"))
    metadata = F.create_map(F.lit("dataset"), F.lit("documents"), F.lit("shard"), F.col("shard_id").cast("string"))
    content = containers.container(F.col("shard_id") * 100, F.col("shard_id") % 7, F.lit(1), metadata, F.col("data"))
    name = F.concat(F.lit("shard_"), F.col("shard_id").cast("string"), F.lit(".ckpt"))
    return joined.select(name.alias("name"), content.alias("content"))


def written_containers(spark, sf):
    path = work_folder(spark, "containers")
    return path, containers.encode_checkpoint(document_containers(spark, sf), path)


SHARD_TEXTS = (
    "shard_texts AS (SELECT n // 50 AS shard, string_agg(text, '' ORDER BY doc_id) AS body, '{\"dataset\":\"documents\",\"shard\":\"' || (n // 50) || '\"}' AS notes "
    "FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) GROUP BY n // 50)"
)


@query(
    "encode_checkpoint",
    with_views(extra=SHARD_TEXTS, query="SELECT 'shard_' || shard || '.ckpt' AS name, CAST(38 + strlen(notes) + strlen(body) AS BIGINT) AS size_bytes FROM shard_texts"),
)
def encode_checkpoint(spark, sf):
    return written_containers(spark, sf)[1]


@query(
    "scan_checkpoints",
    with_views(
        extra=SHARD_TEXTS,
        query="SELECT 'shard_' || shard || '.ckpt' AS name, FALSE AS is_corrupt, 1::BIGINT AS version, TRUE AS version_ok, shard * 100 AS step, shard % 7 AS epoch, "
        "1::BIGINT AS type, FALSE AS compressed, CAST(strlen(body) AS BIGINT) AS data_size, TRUE AS size_ok, 'documents' AS dataset, CAST(shard AS VARCHAR) AS shard, "
        "md5(body) AS data_md5 FROM shard_texts",
    ),
)
def scan_checkpoints(spark, sf):
    path, _ = written_containers(spark, sf)
    scanned = containers.scan_checkpoints(spark, path)
    return scanned.select(
        "name", "is_corrupt", "version", "version_ok", "step", "epoch", "type", "compressed", "data_size", "size_ok",
        F.col("metadata")["dataset"].alias("dataset"),
        F.col("metadata")["shard"].alias("shard"),
        F.md5("data").alias("data_md5"),
    )


CHUNK = 4096


def chunked_containers(spark, sf):
    """The containers of ``document_containers``, each written from one chunk per text."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    shards = shard_samples(docs, ["doc_id"], views.SHARD_SIZES["documents"])
    shard = F.col("shard_id")
    name = F.concat(F.lit("shard_"), shard.cast("string"), F.lit(".ckpt")).alias("name")
    metadata = F.create_map(F.lit("dataset"), F.lit("documents"), F.lit("shard"), shard.cast("string"))
    heads = shards.select("shard_id").distinct().select(
        name, (shard * 100).alias("step"), (shard % 7).alias("epoch"), F.lit(1).alias("kind"), metadata.alias("metadata")
    )
    chunks = shards.select(name, F.col("sample_idx").alias("chunk"), F.encode("text", "UTF-8").alias("data"))
    path = work_folder(spark, "chunked")
    containers.write_chunks(heads, chunks, path)
    return path


@query(
    "scan_headers",
    with_views(
        extra=SHARD_TEXTS,
        query="SELECT 'shard_' || shard || '.ckpt' AS name, CAST(38 + strlen(notes) + strlen(body) AS BIGINT) AS file_size, FALSE AS is_corrupt, TRUE AS version_ok, "
        "shard * 100 AS step, shard % 7 AS epoch, CAST(strlen(body) AS BIGINT) AS data_size, TRUE AS size_ok, CAST(shard AS VARCHAR) AS shard FROM shard_texts",
    ),
)
def scan_headers(spark, sf):
    scanned = containers.scan_headers(spark, chunked_containers(spark, sf))
    return scanned.select(
        "name", "file_size", "is_corrupt", "version_ok", "step", "epoch", "data_size", "size_ok", F.col("metadata")["shard"].alias("shard")
    )


@query(
    "container_chunks",
    with_views(
        extra=SHARD_TEXTS,
        query=f"SELECT name, chunk, chunk * {CHUNK} AS offset, md5(bytes[chunk * {CHUNK} + 1 : (chunk + 1) * {CHUNK}]) AS data_md5 FROM "
        f"(SELECT 'shard_' || shard || '.ckpt' AS name, encode(body) AS bytes, unnest(range(0, (strlen(body) + {CHUNK - 1}) // {CHUNK})) AS chunk FROM shard_texts)",
    ),
)
def container_chunks(spark, sf):
    chunks = containers.read_chunks(spark, chunked_containers(spark, sf), CHUNK)
    return chunks.select("name", "chunk", "offset", F.md5("data").alias("data_md5"))


@query(
    "object_inventory",
    with_views(
        extra=SHARD_TEXTS,
        query="SELECT 'data/shard_' || shard || '.ckpt' AS path, CAST(38 + strlen(notes) + strlen(body) AS BIGINT) AS size_bytes FROM shard_texts WHERE starts_with(CAST(shard AS VARCHAR), '1')",
    ),
)
def object_inventory(spark, sf):
    path, _ = written_containers(spark, sf)
    return inventory(spark, path, "data/shard_1").select("path", "size_bytes")


@query(
    "catalogue_vs_files",
    with_views(
        extra=SHARD_TEXTS,
        query="SELECT 'data/shard_' || shard || '.ckpt' AS path, 'orphan_file' AS finding FROM shard_texts WHERE shard % 5 = 0 "
        "UNION ALL SELECT 'data/shard_' || shard || '.gone', 'missing_file' FROM shard_texts WHERE shard % 5 = 0",
    ),
)
def catalogue_vs_files(spark, sf):
    path, receipts = written_containers(spark, sf)
    # The catalogue names a wrong file for every fifth shard.
    number = F.regexp_extract("name", "([0-9]+)", 1).cast("bigint")
    wrong = F.regexp_replace("name", "ckpt$", "gone")
    entries = receipts.select(F.concat(F.lit("data/"), F.when(number % 5 == 0, wrong).otherwise(F.col("name"))).alias("path"))
    return compare_files(entries, inventory(spark, path, "data/"))
