"""Request metrics, rate limits and error triage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.operators.buckets import token_buckets
from shardloom.operators.ordered import ordered
from shardloom.operators.workers import seconds_between

# Kept latency samples, share of the percentile, idle limit of a
# client, and per error class (retryable, fatal, delay hint in milliseconds).
RECENT_SAMPLES = 1000
SKETCH_K = 1600  # places within 0.3 %
P99 = 0.99
STALE_CLIENT_S = 300
SALTS = 64
ERROR_CLASSES = {
    "WorkerNotFound": (False, False, None),
    "WorkerAlreadyRegistered": (False, False, None),
    "WorkerHeartbeatTimeout": (True, False, 1000),
    "InvalidWorkerState": (False, False, None),
    "CheckpointNotFound": (False, False, None),
    "CheckpointWriteFailed": (False, False, None),
    "CheckpointCorrupted": (False, True, None),
    "NoCheckpointForRecovery": (False, False, None),
    "DatasetNotFound": (False, False, None),
    "ShardNotFound": (False, False, None),
    "InvalidShardConfig": (False, False, None),
    "Storage": (True, False, 100),
    "StorageUnavailable": (True, False, 5000),
    "StoragePathNotFound": (False, False, None),
    "BarrierTimeout": (True, False, 500),
    "BarrierExists": (False, False, None),
    "CoordinatorUnavailable": (True, False, 2000),
    "InvalidConfig": (False, True, None),
    "Io": (False, False, None),
    "Serialization": (False, False, None),
    "Grpc": (True, False, 100),
    "Internal": (False, True, None),
    "Timeout": (True, False, 1000),
    "ChannelClosed": (False, False, None),
}


def newest_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group, adding ``newest`` from 1.

    A first cut per (group, salt) leaves at most ``n`` rows per salt, so a group
    with most of the table never meets one task. Spark limits each window group
    before the shuffle as well.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    latest = [F.desc(c) for c in order]
    for keys in ([*by, "__salt"], by):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*latest))
        salted = salted.withColumn("newest", rank).filter(F.col("newest") <= n)
    return salted.drop("__salt").withColumn("newest", F.col("newest").cast("bigint"))


def p99_index(n: Column) -> Column:
    """Place of the percentile in n sorted values: floor(0.99 n), at most n - 1."""
    return F.least(F.floor(n.cast("double") * P99).cast("bigint"), n - 1)


def rank_p99(df: DataFrame, by: Sequence[str], value: str, tie: str) -> DataFrame:
    """Exact 99th percentile of each group by its place in the order of values."""
    placed = ordered(df, by, [value, tie], position="p99_place", total="p99_rows")
    hit = placed.filter(F.col("p99_place") == p99_index(F.col("p99_rows")))
    return hit.select(*by, F.col("p99_rows").alias("samples"), F.col(value).alias("p99"))


def recent_p99(requests: DataFrame, last: int = RECENT_SAMPLES) -> DataFrame:
    """99th percentile latency of the last samples of each method."""
    recent = newest_per_group(requests.select("method", "latency_us", "ts", "event_id"), ["method"], ["ts", "event_id"], last)
    # At most ``last`` rows per method are left here.
    group = Window.partitionBy("method")
    place = F.row_number().over(group.orderBy("latency_us", "event_id")) - 1
    placed = recent.select("method", "latency_us", place.alias("place"), F.count(F.lit(1)).over(group).alias("n"))
    hit = placed.filter(F.col("place") == p99_index(F.col("n")))
    return hit.select("method", F.col("n").alias("samples"), F.col("latency_us").alias("p99_us"))


def request_summary(requests: DataFrame, last: int = RECENT_SAMPLES) -> DataFrame:
    """Requests, errors and recent 99th percentile per method."""
    counts = requests.groupBy("method").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("is_error").alias("errors")
    )
    return counts.join(recent_p99(requests, last).select("method", "p99_us"), "method", "left")


def sketch_quantile(sketch: Column, samples: Column, q: float) -> Column:
    """The value at place floor(q n), at most n - 1, of the sketched values; null for none."""
    # A sketch answers with place ceil(q n) - 1, which a little more than q makes floor(q n).
    return F.when(samples > 0, F.kll_sketch_get_quantile_bigint(sketch, F.lit(q + 1e-6)))


def latency_sketches(requests: DataFrame, width: str = "1 minute", k: int = SKETCH_K) -> DataFrame:
    """Requests, errors and a mergeable KLL sketch of the latencies per window and method.

    A sketch of size ``k`` is exact up to about ``k`` values; beyond, the places
    of its quantiles are off by some 2.3 / k^0.9 of the number of values, also
    after merges. It holds a few times ``k`` values, however many it has seen.
    """
    per = requests.groupBy(F.window("ts", width).alias("w"), "method").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("is_error").alias("errors"),
        F.count("latency_us").alias("samples"),
        F.kll_sketch_agg_bigint("latency_us", F.lit(k)).alias("sketch"),
    )
    sketch = F.when(F.col("samples") > 0, F.col("sketch"))
    return per.select(F.col("w.start").alias("window_start"), "method", "requests", "errors", "samples", sketch.alias("sketch"))


def merged_summary(sketches: DataFrame, by: Sequence[str | Column], k: int = SKETCH_K) -> DataFrame:
    """Requests, errors, median and 99th percentile per group of ``latency_sketches``; raw requests are not read again."""
    per = sketches.groupBy(*by).agg(
        F.sum("requests").alias("requests"),
        F.sum("errors").alias("errors"),
        F.sum("samples").alias("samples"),
        F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"),
    )
    n = F.col("samples")
    p50, p99 = (sketch_quantile(F.col("sketch"), n, q) for q in (0.5, P99))
    return per.withColumns({"p50_us": p50, "p99_us": p99}).drop("sketch")


def requests_per_second(requests: DataFrame) -> DataFrame:
    """Whole requests per second over the span of the log, at least one second."""
    span = seconds_between(F.min("ts"), F.max("ts"))
    seconds = F.greatest(F.floor(span), F.lit(1))
    return requests.agg(F.count(F.lit(1)).alias("requests"), seconds.cast("bigint").alias("seconds")).withColumn(
        "rps", F.floor(F.col("requests") / F.col("seconds")).cast("bigint")
    )


def rate_limit(requests: DataFrame, rate: float, burst: int, slices: int | None = None) -> DataFrame:
    """Decide every request of (client, ts, event_id) by a token bucket per client."""
    decided = token_buckets(requests, rate, burst, slices=slices)
    retry = F.when(~F.col("allowed"), F.lit(1.0 / rate))
    return decided.select("client", "event_id", "allowed", "tokens_left", retry.alias("retry_after_s"))


def stale_clients(requests: DataFrame, as_of: Column, rate: float, burst: int, idle_s: float = STALE_CLIENT_S) -> DataFrame:
    """Clients whose bucket would be dropped: its last refill is the limit or longer ago.

    A refill adds a whole token at least, so a client that keeps asking faster
    than that has an old refill although its last request is new.
    """
    marks = token_buckets(requests, rate, burst).groupBy("client").agg(F.max("mark_us").alias("mark_us"))
    idle = (F.unix_micros(as_of.cast("timestamp")) - F.col("mark_us")) / 1_000_000
    refill = F.timestamp_micros("mark_us").cast("timestamp_ntz")
    return marks.select("client", refill.alias("last_refill"), idle.alias("idle_s")).filter(F.col("idle_s") >= idle_s)


def error_triage(errors: DataFrame) -> DataFrame:
    """Per error class: count, retryable, fatal and the total delay hinted."""
    counts = errors.groupBy("error_class").agg(F.count(F.lit(1)).alias("errors"))
    kind = F.col("error_class")

    def among(place: int) -> Column:
        return kind.isin([name for name, facts in ERROR_CLASSES.items() if facts[place]])

    delay = F.lit(None).cast("bigint")
    for name, (_, _, hint) in ERROR_CLASSES.items():
        if hint is not None:
            delay = F.when(kind == name, F.lit(hint).cast("bigint")).otherwise(delay)
    return counts.select(
        "error_class",
        "errors",
        among(0).alias("retryable"),
        among(1).alias("fatal"),
        delay.alias("delay_hint_ms"),
        (delay * F.col("errors")).alias("total_delay_ms"),
    )


def latency_histogram(requests: DataFrame, bounds: Sequence[int]) -> DataFrame:
    """Cumulative counts per upper bound (and +Inf) for every method, in one pass."""
    limits = list(bounds)
    counts = [F.count_if(F.col("latency_us") <= b).alias(f"le{i}") for i, b in enumerate(limits)]
    wide = requests.groupBy("method").agg(*counts, F.count(F.lit(1)).alias("every"))
    entries = [F.struct(F.lit(str(b)).alias("le"), F.col(f"le{i}").alias("requests")) for i, b in enumerate(limits)]
    entries.append(F.struct(F.lit("+Inf").alias("le"), F.col("every").alias("requests")))
    return wide.select("method", F.explode(F.array(*entries)).alias("b")).select("method", "b.*")
