"""Queries that index, shard, shuffle, split and deliver the rows themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.operators import delivery as dl
from shardloom.operators import packed
from shardloom.plans.placement import plan_of, ranked
from shardloom.plans.registry import query
from shardloom.plans.sql_views import with_views
from shardloom.session import small, work_folder
from shardloom.sources import views
from shardloom.sources.tables import load, table
from shardloom.sources.tfrecord import write_tfrecord
from shardloom.sources.webdataset import write_webdataset

LINE_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
ASSIGN_SQL = "JOIN assignment_v a ON a.dataset_id = '{0}' AND a.shard_id = s.sample_idx // {1}"


def lineitem_samples(spark, sf):
    lines = table(spark, sf, "lineitem")
    return dl.shard_samples(lines, views.LINEITEM_ORDER, views.SHARD_SIZES["lineitem"])


@query("index_samples", with_views("indexed_lineitem_v", query=f"SELECT sample_idx, {LINE_KEYS} FROM indexed_lineitem_v"))
def index_samples(spark, sf):
    lines = table(spark, sf, "lineitem").select(*views.LINEITEM_ORDER)
    indexed = dl.index_samples(lines, views.LINEITEM_ORDER)
    return indexed.select("sample_idx", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "shard_samples",
    with_views(
        "indexed_lineitem_v",
        query="SELECT sample_idx // 1000 AS shard_id, count(*) AS num_samples, min(sample_idx) AS first_idx, max(sample_idx) AS last_idx, "
        "CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity FROM indexed_lineitem_v GROUP BY 1",
    ),
)
def shard_samples(spark, sf):
    return lineitem_samples(spark, sf).groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.min("sample_idx").alias("first_idx"),
        F.max("sample_idx").alias("last_idx"),
        F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double").alias("quantity"),
    )


@query(
    "epoch_samples",
    with_views(
        "assignment_v", "indexed_lineitem_v",
        query="SELECT a.worker_id, a.epoch, count(*) AS samples, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity "
        "FROM indexed_lineitem_v s " + ASSIGN_SQL.format("lineitem", 1000) + " GROUP BY ALL",
    ),
)
def epoch_samples(spark, sf):
    plan = plan_of(spark, sf, names=("lineitem",))
    rows = dl.epoch_samples(lineitem_samples(spark, sf), plan)
    return rows.groupBy("worker_id", "epoch").agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double").alias("quantity"),
    )


@query(
    "epoch_sample_rows",
    with_views(
        "assignment_v",
        query="SELECT a.epoch, a.worker_id, a.order_index, a.shard_id, s.sample_idx, s.doc_id, md5(s.text) AS text_md5 FROM "
        "(SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS sample_idx FROM documents) s "
        + ASSIGN_SQL.format("documents", 50),
    ),
)
def epoch_sample_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    samples = dl.shard_samples(docs, ["doc_id"], views.SHARD_SIZES["documents"])
    rows = dl.deliver(dl.epoch_samples(samples, plan_of(spark, sf, names=("documents",))))
    return rows.select(
        "epoch", "worker_id", "order_index", "shard_id", "sample_idx", "doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5")
    )


@query(
    "data_preview",
    with_views(
        "assignment_v", "indexed_lineitem_v",
        query=f"SELECT a.epoch, a.worker_id, a.shard_id, s.sample_idx, {LINE_KEYS} FROM indexed_lineitem_v s "
        + ASSIGN_SQL.format("lineitem", 1000) + " WHERE s.sample_idx % 1000 < 3",
    ),
)
def data_preview(spark, sf):
    plan = plan_of(spark, sf, names=("lineitem",))
    rows = dl.epoch_samples(lineitem_samples(spark, sf), plan)
    shown = dl.preview(rows, views.SHARD_SIZES["lineitem"], 3)
    return shown.select(
        "epoch", "worker_id", "shard_id", "sample_idx", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )


@query(
    "preview_counts",
    with_views(
        "assignment_v", "indexed_lineitem_v",
        query="SELECT a.epoch, count(*) AS samples, count(DISTINCT a.shard_id) AS shards, count(DISTINCT a.worker_id) AS workers "
        "FROM indexed_lineitem_v s " + ASSIGN_SQL.format("lineitem", 1000) + " GROUP BY a.epoch",
    ),
)
def preview_counts(spark, sf):
    rows = dl.epoch_samples(lineitem_samples(spark, sf), plan_of(spark, sf, names=("lineitem",)))
    # Pre-aggregating per shard keeps the distinct counts off the sample rows.
    shards = rows.groupBy("epoch", "shard_id", "worker_id").agg(F.count(F.lit(1)).alias("samples"))
    return shards.groupBy("epoch").agg(
        F.sum("samples").alias("samples"),
        F.count_distinct("shard_id").alias("shards"),
        F.count_distinct("worker_id").alias("workers"),
    )


@query(
    "shuffle_samples",
    "SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws('|', 42, 'orders', 1, o_orderkey)), o_orderkey) - 1 AS position FROM orders",
)
def shuffle_samples(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return dl.shuffle_samples(orders, "o_orderkey", dataset="orders", epoch=1)


@query(
    "contiguous_split",
    "SELECT c_custkey, n AS sample_idx, n // b AS rank FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS n, "
    "(SELECT count(*) FROM customer) // 7 AS b FROM customer) WHERE n // b < 7",
)
def contiguous_split(spark, sf):
    return dl.contiguous_split(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 7)


@query(
    "train_test_split",
    "SELECT vec_id, n AS sample_idx, CASE WHEN n < (SELECT count(*) FROM embeddings) * 80 // 100 THEN 'train' ELSE 'test' END AS split "
    "FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings)",
)
def train_test_split(spark, sf):
    return dl.train_test_split(table(spark, sf, "embeddings").select("vec_id"), ["vec_id"])


@query(
    "mini_batches",
    "SELECT n // 32 AS batch, count(*) AS rows, min(n) AS first_idx, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM "
    "(SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws('|', 42, 'orders', 0, o_orderkey)), o_orderkey) - 1 AS n FROM orders) GROUP BY 1",
)
def mini_batches(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    shuffled = dl.shuffle_samples(orders, "o_orderkey", dataset="orders")
    return dl.mini_batches(shuffled, "position", 32).groupBy("batch").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("position").alias("first_idx"),
        F.sum("o_orderkey").alias("key_sum"),
    )


@query(
    "batch_summary",
    "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS batches, CAST(sum(n) // 32 AS BIGINT) AS steps_per_epoch, min(n) AS smallest_batch, "
    "max(n) AS largest_batch FROM (SELECT count(*) AS n FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) GROUP BY i // 32)",
)
def batch_summary(spark, sf):
    orders = dl.index_samples(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])
    return dl.batch_summary(dl.mini_batches(orders, "sample_idx", 32), 32)


@query(
    "label_shift",
    "SELECT vec_id, label, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) + (label - 5) * 0.5::DOUBLE AS x "
    "FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)",
)
def label_shift(spark, sf):
    shifted = dl.label_shift(table(spark, sf, "embeddings"), "embedding", "label")
    return shifted.select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")).withColumn("dim", F.col("dim").cast("bigint"))


@query(
    "normalize_features",
    "SELECT vec_id, dim, round((x - m) / s, 6) AS x FROM (SELECT vec_id, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS x "
    "FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)) JOIN (SELECT i - 1 AS dim, avg(CAST(embedding[i] AS DOUBLE)) AS m, "
    "stddev_pop(CAST(embedding[i] AS DOUBLE)) AS s FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1) USING (dim)",
)
def normalize_features(spark, sf):
    scaled = dl.normalize_features(table(spark, sf, "embeddings"), "embedding")
    return scaled.select("vec_id", F.posexplode("embedding").alias("dim", "x")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("x")
    )


@query(
    "per_worker_dataset",
    with_views(
        "ranked_v", "manifest_v",
        query="SELECT w.worker_id, w.rank, coalesce(m.dataset_id, 'lineitem') AS dataset_id FROM ranked_v w LEFT JOIN "
        "(SELECT dataset_id, row_number() OVER (ORDER BY dataset_id) - 1 AS n FROM manifest_v) m ON m.n = w.rank",
    ),
)
def per_worker_dataset(spark, sf):
    manifest = small(views.manifest(spark, sf).select("dataset_id"))
    numbered = dl.index_samples(manifest, ["dataset_id"], out="rank")
    workers = ranked(spark, sf).select("worker_id", "rank")
    choices = workers.join(numbered, "rank")
    return dl.per_worker_dataset(workers, choices, "lineitem")


OWN_ORDERS_SQL = with_views(
    "assignment_v",
    query="SELECT a.shard_id, a.order_index, s.sample_idx, s.o_orderkey, s.o_totalprice FROM "
    "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS sample_idx FROM orders) s "
    + ASSIGN_SQL.format("orders", 500) + " WHERE a.epoch = 1 AND a.worker_id = (SELECT max(worker_id) FROM assignment_v WHERE dataset_id = 'orders')",
)


@query("read_shard", OWN_ORDERS_SQL)
def read_shard(spark, sf):
    plan = plan_of(spark, sf, names=("orders",))
    owner = plan.agg(F.max("worker_id")).first()[0]
    path = written_orders(spark, sf)
    rows = dl.read_shard(spark, path, plan, owner, 1)
    return rows.select(F.col("shard_id").cast("bigint").alias("shard_id"), "order_index", "sample_idx", "o_orderkey", "o_totalprice")


def written_orders(spark, sf):
    path = work_folder(spark, "orders")
    dl.write_sharded(dl.shard_samples(table(spark, sf, "orders"), ["o_orderkey"], views.SHARD_SIZES["orders"]), path)
    return path


@query(
    "write_sharded",
    "SELECT n // 500 AS shard_id, count(*) AS num_samples, 1::BIGINT AS files FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) GROUP BY 1",
)
def write_sharded(spark, sf):
    files = dl.shard_files(spark, written_orders(spark, sf))
    return files.select("shard_id", "num_samples", F.size("file_paths").cast("bigint").alias("files"))


def packed_orders(spark, sf):
    path = work_folder(spark, "orders-packed")
    size = views.SHARD_SIZES["orders"]
    samples = dl.shard_samples(table(spark, sf, "orders"), ["o_orderkey"], size)
    packed.write_packed(samples, path, shard_rows=size, file_bytes=4 << 20)
    return path


@query("read_packed_shard", OWN_ORDERS_SQL)
def read_packed_shard(spark, sf):
    plan = plan_of(spark, sf, names=("orders",))
    owner = plan.agg(F.max("worker_id")).first()[0]
    rows = packed.read_packed_shard(spark, packed_orders(spark, sf), plan, owner, 1)
    return rows.select("shard_id", "order_index", "sample_idx", "o_orderkey", "o_totalprice")


@query(
    "write_packed",
    "SELECT n // 500 AS shard_id, count(*) AS num_samples, 1::BIGINT AS files FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) GROUP BY 1",
)
def write_packed(spark, sf):
    index = packed.packed_index(spark, packed_orders(spark, sf))
    return index.groupBy(F.col("id").alias("shard_id")).agg(F.sum("num_rows").alias("num_samples"), F.count(F.lit(1)).alias("files"))


@query(
    "format_sources",
    "SELECT f.format, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS price, "
    "min(o_orderdate) AS first_date, max(o_orderpriority) AS last_priority FROM orders, (VALUES ('parquet'), ('csv'), ('jsonl')) f(format) GROUP BY 1",
)
def format_sources(spark, sf):
    orders = table(spark, sf, "orders")
    parts = []
    for fmt in ("parquet", "csv", "jsonl"):
        path = work_folder(spark, f"orders-{fmt}")
        writer = orders.write.format("json" if fmt == "jsonl" else fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(path)
        parts.append(load(spark, fmt, path, orders.schema).withColumn("format", F.lit(fmt)))
    read = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return read.groupBy("format").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("o_orderkey").alias("key_sum"),
        F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("price"),
        F.min("o_orderdate").alias("first_date"),
        F.max("o_orderpriority").alias("last_priority"),
    )


@query("tfrecord_source", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def tfrecord_source(spark, sf):
    # All columns are written, five of six are decoded.
    path = work_folder(spark, "orders-tfrecord")
    write_tfrecord(table(spark, sf, "orders"), path)
    schema = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate").schema
    return load(spark, "tfrecord", path, schema, split_bytes=4 << 20)


@query("webdataset_source", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def webdataset_source(spark, sf):
    path = work_folder(spark, "documents-webdataset")
    docs = table(spark, sf, "documents")
    about = F.to_json(F.struct("doc_id", "lang", "source", "n_chars"))
    samples = docs.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("txt"), about.alias("json"))
    write_webdataset(samples, path, "key", ["txt", "json"])
    read = load(spark, "webdataset", path, extensions=["txt", "json"], split_bytes=4 << 20)
    notes = F.from_json(F.try_element_at("members", F.lit("json")).cast("string"), "doc_id bigint, lang string, source string, n_chars bigint")
    text = F.try_element_at("members", F.lit("txt")).cast("string")
    return read.select(text.alias("text"), notes.alias("n")).select("n.doc_id", "text", "n.lang", "n.source", "n.n_chars")
