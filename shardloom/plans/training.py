"""Queries for training metrics and for chunked payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.operators import chunks as ch
from shardloom.operators import training as tr
from shardloom.plans.registry import query
from shardloom.plans.sql_views import with_views
from shardloom.sources import views
from shardloom.sources.tables import table

STEPS_PER_EPOCH, BLOCK, CHUNKS = 20, 10, 7
KEY = b"a repeating chunk key"  # any key works; the transform is its own inverse
EPOCHS = (
    "epochs AS (SELECT run, step // 20 AS epoch, count(*) AS batches, CAST(sum(loss) AS DOUBLE) / count(*) AS mean_loss, "
    "CAST(sum(correct) AS BIGINT) * 100 / count(*) AS accuracy FROM steps_v GROUP BY 1, 2)"
)


def steps(spark, sf):
    return tr.numbered_steps(views.runs(spark, sf))


@query("numbered_steps", with_views("steps_v", query="SELECT run, ts, event_id, CAST(loss AS DOUBLE) AS loss, correct, step FROM steps_v"))
def numbered_steps(spark, sf):
    return steps(spark, sf).withColumn("loss", F.col("loss").cast("double"))


@query("epoch_metrics", with_views("steps_v", extra=EPOCHS, query="SELECT run, epoch, batches, mean_loss, accuracy FROM epochs"))
def epoch_metrics(spark, sf):
    return tr.epoch_metrics(steps(spark, sf), STEPS_PER_EPOCH)


@query(
    "windowed_loss",
    with_views(
        "steps_v",
        query="SELECT run, (b + 1) * 10 AS batch, CAST(loss AS DOUBLE) / 10 AS mean_loss, CAST(good AS BIGINT) * 100 / ((b + 1) * 10) AS accuracy FROM "
        "(SELECT run, step // 10 AS b, sum(loss) AS loss, count(*) AS n, sum(sum(correct)) OVER (PARTITION BY run ORDER BY step // 10) AS good FROM steps_v GROUP BY run, step // 10) WHERE n = 10",
    ),
)
def windowed_loss(spark, sf):
    return tr.windowed_loss(steps(spark, sf), BLOCK)


@query(
    "argmax_accuracy",
    "SELECT label, count(*) AS total, count(*) FILTER (WHERE hit) AS correct, count(*) FILTER (WHERE hit) * 100 / count(*) AS accuracy FROM "
    "(SELECT label, list_position(embedding, list_max(embedding)) - 1 = label AS hit FROM embeddings) GROUP BY label",
)
def argmax_accuracy(spark, sf):
    scored = table(spark, sf, "embeddings").select("label", F.col("embedding").alias("scores"))
    return tr.argmax_accuracy(scored, "scores", "label", ["label"])


@query(
    "final_metrics_rollup",
    with_views(
        "steps_v",
        extra=EPOCHS + ", last AS (SELECT run, mean_loss, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS n FROM epochs) WHERE n = 1)",
        query="SELECT CAST(run AS VARCHAR) AS run, mean_loss AS loss, round(accuracy, 6) AS accuracy FROM last UNION ALL SELECT 'Average', NULL, round(avg(accuracy), 6) FROM last",
    ),
)
def final_metrics_rollup(spark, sf):
    metrics = tr.epoch_metrics(steps(spark, sf), STEPS_PER_EPOCH).withColumnRenamed("mean_loss", "loss")
    return tr.final_metrics_rollup(metrics).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "training_rate",
    with_views(
        "steps_v",
        query="SELECT run, step, r AS steps_per_s, r * 32 AS samples_per_s, CASE WHEN r > 0 THEN CAST(greatest(1000 - step, 0) AS DOUBLE) / r END AS eta_s FROM "
        "(SELECT run, step, CAST(1 AS DOUBLE) / nullif((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run ORDER BY ts, event_id))) / 1000000, 0) AS r FROM steps_v)",
    ),
)
def training_rate(spark, sf):
    return tr.training_rate(steps(spark, sf), batch_size=32, total_steps=1000)


def payloads(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("payload"))


CHUNK_SQL = (
    "cut AS (SELECT doc_id, h, total, o AS off, least(size, total - o) AS bytes FROM (SELECT *, unnest(range(0, total, size)) AS o FROM "
    "(SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS total, greatest(CAST(ceil(strlen(text) / 7) AS BIGINT), 1) AS size FROM documents)))"
)


@query(
    "chunk_payload",
    with_views(
        extra=CHUNK_SQL,
        query="SELECT doc_id, CAST(total AS BIGINT) AS total_size, CAST(off AS BIGINT) AS \"offset\", CAST(bytes AS BIGINT) AS chunk_bytes, "
        "md5(substr(h, off * 2 + 1, bytes * 2)) AS chunk_md5 FROM cut",
    ),
)
def chunk_payload(spark, sf):
    cut = ch.chunk_payload(payloads(spark, sf), "payload", CHUNKS)
    return cut.select(
        "doc_id",
        F.col("total_size").cast("bigint").alias("total_size"),
        F.col("offset").cast("bigint").alias("offset"),
        F.octet_length("chunk").cast("bigint").alias("chunk_bytes"),
        F.md5(F.encode(F.hex("chunk"), "UTF-8")).alias("chunk_md5"),
    )


@query(
    "map_chunks",
    with_views(
        extra=CHUNK_SQL,
        query="SELECT doc_id, CAST(off AS BIGINT) AS \"offset\", md5(list_aggregate(list_transform(range(bytes), lambda i: printf('%02X', xor("
        "CAST('0x' || digits[i * 2 + 1] || digits[i * 2 + 2] AS BIGINT), ascii('" + KEY.decode() + f"'[(off + i) % {len(KEY)} + 1])::BIGINT))), 'string_agg', '')) AS chunk_md5 FROM (SELECT *, string_split(substr(h, off * 2 + 1, bytes * 2), '') AS digits FROM cut)",
    ),
)
def map_chunks(spark, sf):
    mapped = ch.map_chunks(ch.chunk_payload(payloads(spark, sf), "payload", CHUNKS), KEY)
    digest = F.md5(F.encode(F.hex("chunk"), "UTF-8"))
    return mapped.select("doc_id", F.col("offset").cast("bigint").alias("offset"), digest.alias("chunk_md5"))


@query("reassemble", "SELECT doc_id, TRUE AS complete, md5(text) AS payload_md5 FROM documents")
def reassemble(spark, sf):
    encoded = ch.map_chunks(ch.chunk_payload(payloads(spark, sf), "payload", CHUNKS), KEY)
    restored = ch.reassemble(ch.map_chunks(encoded, KEY), "doc_id")
    return restored.select("doc_id", "complete", F.md5("payload").alias("payload_md5"))
