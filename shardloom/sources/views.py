"""Views over the given tables in the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators.manifest import dataset_manifest
from shardloom.sources.tables import DatasetSpec, table

# Shard size by table, the shuffled tables, seed, worker count and clock.
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
SHARD_SIZES = {"lineitem": 1000, "orders": 500, "documents": 50}
DEFAULT_SHARD_SIZE = 100
SHUFFLED = {"lineitem", "documents"}
SEED = 42
WORKERS = 16
AS_OF = "2024-01-31 00:00:00"
SYMBOLS = ["AAPL", "GOOGL", "MSFT", "AMZN"]
STATES = {
    "view": "TRAINING",
    "click": "LOADING_DATA",
    "purchase": "CHECKPOINTING",
    "signup": "IDLE",
    "error": "ERROR",
}
ACTIONS = {"view": "training", "click": "loading", "purchase": "checkpoint"}
LEVELS = {"error": "error", "purchase": "warn", "view": "debug"}
WRITE_STATES = {
    "signup": "Pending",
    "view": "Pending",
    "click": "InProgress",
    "purchase": "Completed",
    "error": "Failed",
}
# A unique order of the lineitem rows.
LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def choose(column, values: dict[str, str], default=None):
    """CASE over fixed values."""
    case = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, value in values.items():
        case = case.when(column == key, F.lit(value))
    return case.otherwise(F.lit(default).cast("string"))


def worker_name(number):
    return F.concat(F.lit("worker-"), number.cast("string"))


def specs(sf_dir: str, names=tuple(TABLES)) -> list[DatasetSpec]:
    return [
        DatasetSpec(
            name,
            f"{sf_dir}/{name}.parquet",
            SHARD_SIZES.get(name, DEFAULT_SHARD_SIZE),
            shuffle=name in SHUFFLED,
            seed=SEED,
        )
        for name in names
    ]


def manifest(spark: SparkSession, sf_dir: str, names=tuple(TABLES)) -> DataFrame:
    return dataset_manifest(spark, specs(sf_dir, names))


def prop_k(props):
    return F.get_json_object(props, "$.k").cast("bigint")


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """worker_id, registered_at, gpu_count; one worker per user number modulo 16."""
    number = F.col("user_id") % WORKERS
    seen = table(spark, sf_dir, "events").groupBy(number.alias("number")).agg(F.min("ts").alias("registered_at"))
    return seen.select(
        worker_name(F.col("number")).alias("worker_id"),
        "registered_at",
        (4 + 4 * (F.col("number") % 2)).cast("bigint").alias("gpu_count"),
    )


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch events per dataset; one of the four ids is not registered."""
    names = F.array(*[F.lit(n) for n in ("lineitem", "orders", "documents", "unregistered")])
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "click"))
    return events.select(
        F.get(names, (F.col("event_id") % 4).cast("int")).alias("dataset_id"),
        F.when(F.col("event_type") == "signup", "init").otherwise("advance").alias("op"),
        (prop_k(F.col("props")) % 5).alias("epoch"),
        "ts",
        "event_id",
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heartbeat_columns(table(spark, sf_dir, "events"))


def heartbeat_columns(events: DataFrame) -> DataFrame:
    k = prop_k(F.col("props"))
    symbol = F.get(F.array(*[F.lit(s) for s in SYMBOLS]), (k % 4).cast("int"))
    action = choose(F.col("event_type"), ACTIONS)
    day = F.dayofmonth("ts").cast("bigint")
    return events.select(
        "event_id",
        "ts",
        worker_name(F.col("user_id") % WORKERS).alias("worker_id"),
        choose(F.col("event_type"), STATES).alias("state"),
        k.alias("current_step"),
        day.alias("current_epoch"),
        F.concat(action, F.lit("_"), symbol, F.lit("_epoch"), day.cast("string")).alias("current_task"),
        F.least(F.lit(100.0), F.col("value") / 5).alias("cpu_percent"),
        (F.col("event_id") * 1024).alias("memory_used_bytes"),
    )


def gpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GPU reading for each value of a vector, as an array of structs."""
    # DOUBLE arithmetic on the FLOAT values gives the same bits in every engine.
    reading = lambda x, i: F.struct(
        i.cast("bigint").alias("gpu_id"),
        (F.abs(x.cast("double")) * 100).alias("utilization_percent"),
        (F.col("vec_id") * 1024 + i).alias("memory_used_bytes"),
        (F.col("vec_id") * 4096 + 8).alias("memory_total_bytes"),
        (F.abs(x.cast("double")) * 50 + 30).alias("temperature_celsius"),
    )
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        worker_name(F.col("vec_id") % WORKERS).alias("worker_id"),
        F.transform("embedding", reading).alias("gpus"),
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrival_columns(table(spark, sf_dir, "events"))


def arrival_columns(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("epoch-"), (prop_k(F.col("props")) % 10).cast("string")).alias("barrier_id"),
        worker_name(F.col("user_id") % WORKERS).alias("worker_id"),
        "ts",
        "event_id",
    )


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint_columns(table(spark, sf_dir, "orders"))


def checkpoint_columns(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.concat(F.lit("ckpt-"), F.col("o_orderkey").cast("string")).alias("checkpoint_id"),
        (F.col("o_orderkey") % 500).alias("step"),
        (F.year("o_orderdate") - 1995).cast("bigint").alias("epoch"),
        worker_name(F.col("o_custkey") % WORKERS).alias("worker_id"),
        F.concat(F.lit("/ckpt/"), F.col("o_orderkey").cast("string")).alias("path"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("size_bytes"),
        F.col("o_orderdate").alias("notified_at"),
        F.col("o_orderkey").alias("notification"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("metadata"),
    )


def write_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = choose(F.col("event_type"), WRITE_STATES)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("ckpt-"), F.col("user_id").cast("string")).alias("checkpoint_id"),
        status.alias("status"),
        F.when(status == "Failed", F.col("props")).alias("error"),
        "ts",
        "event_id",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_columns(table(spark, sf_dir, "events"))


def request_columns(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.col("user_id").alias("client"),
        F.col("event_type").alias("method"),
        F.round(F.col("value") * 1000).cast("bigint").alias("latency_us"),
        (F.col("value") >= 200).alias("is_error"),
        "ts",
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = {"P": "running", "F": "completed", "O": "pending"}
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("task_"), F.col("o_orderkey").cast("string")).alias("task_id"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderdate").alias("started_at"),
        choose(F.col("o_orderstatus"), states).alias("status"),
        (1 + F.col("o_orderkey") % 4).alias("worker_count"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"),
        F.col("ts").alias("time"),
        choose(F.col("event_type"), LEVELS, "info").alias("level"),
        F.col("event_type").alias("source"),
        F.col("props").alias("message"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training steps before numbering: one run per user."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        "ts",
        "event_id",
        F.col("value").cast("decimal(12,2)").alias("loss"),
        (prop_k(F.col("props")) >= 50).cast("bigint").alias("correct"),
    )
