"""Queries over requests, limits, validation and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions import checks
from shardloom.operators import requests as rq
from shardloom.plans.registry import query
from shardloom.plans.sql_views import K, with_views
from shardloom.plans.workers import AS_OF_SQL
from shardloom.sources import views
from shardloom.sources.tables import table

RATE, BURST = 1.0 / 14400, 3
BOUNDS = [1000, 5000, 10000, 25000, 50000, 100000, 250000]
P99_SQL = (
    "recent AS (SELECT method, latency_us, event_id FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY ts DESC, event_id DESC) AS n FROM requests_v) WHERE n <= 1000), "
    "p99 AS (SELECT method, n AS samples, latency_us AS p99_us FROM (SELECT method, latency_us, row_number() OVER (PARTITION BY method ORDER BY latency_us, event_id) - 1 AS p, "
    "count(*) OVER (PARTITION BY method) AS n FROM recent) WHERE p = least(CAST(floor(n * 0.99::DOUBLE) AS BIGINT), n - 1))"
)


def placed_sql(q: float) -> str:
    """The latency at place floor(q n), at most n - 1, of a group."""
    return f"list_sort(list(latency_us))[least(floor(count(latency_us) * {q}::DOUBLE), count(latency_us) - 1)::BIGINT + 1]"


@query("recent_p99", with_views("requests_v", extra=P99_SQL, query="SELECT method, samples, p99_us FROM p99"))
def recent_p99(spark, sf):
    return rq.recent_p99(views.requests(spark, sf))


@query(
    "request_summary",
    with_views(
        "requests_v", extra=P99_SQL,
        query="SELECT r.method, count(*) AS requests, count(*) FILTER (WHERE is_error) AS errors, any_value(p99_us) AS p99_us FROM requests_v r JOIN p99 ON r.method = p99.method GROUP BY r.method",
    ),
)
def request_summary(spark, sf):
    return rq.request_summary(views.requests(spark, sf))


@query(
    "request_quantiles",
    with_views(
        "requests_v",
        query="SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, method, count(*) AS requests, count(*) FILTER (WHERE is_error) AS errors, count(latency_us) AS samples, "
        f"{placed_sql(0.5)} AS p50_us, {placed_sql(0.99)} AS p99_us FROM requests_v GROUP BY 1, 2",
    ),
)
def request_quantiles(spark, sf):
    """Days put together from the sketches of their minutes; exact while a method has few requests a day."""
    minutes = rq.latency_sketches(views.requests(spark, sf))
    return rq.merged_summary(minutes, [F.date_trunc("day", "window_start").cast("timestamp_ntz").alias("day"), "method"])


@query(
    "requests_per_second",
    with_views(
        "requests_v",
        query="SELECT n AS requests, s AS seconds, n // s AS rps FROM (SELECT count(*) AS n, greatest((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000, 1) AS s FROM requests_v)",
    ),
)
def requests_per_second(spark, sf):
    return rq.requests_per_second(views.requests(spark, sf))


WALK = (
    "r AS (SELECT client, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY client ORDER BY ts, event_id) AS n FROM requests_v), "
    f"walk AS (SELECT client, event_id, n, us AS mark, {BURST - 1}::BIGINT AS tokens, TRUE AS allowed FROM r WHERE n = 1 UNION ALL "
    "SELECT r.client, r.event_id, r.n, CASE WHEN a.added > 0 THEN r.us ELSE w.mark END, greatest(t.full_tokens - 1, 0), t.full_tokens > 0 FROM walk w "
    "JOIN r ON r.client = w.client AND r.n = w.n + 1, LATERAL (SELECT CAST(floor(((r.us - w.mark) // 1000000 + ((r.us - w.mark) % 1000000 * 1000) / 1e9::DOUBLE) "
    f"* (1.0::DOUBLE / 14400)) AS BIGINT) AS added) a, LATERAL (SELECT CASE WHEN a.added > 0 THEN least(w.tokens + a.added, {BURST}) ELSE w.tokens END AS full_tokens) t)"
)


@query(
    "rate_limit",
    with_views(
        "requests_v", recursive=True,
        extra=WALK,
        query="SELECT client, event_id, allowed, tokens AS tokens_left, CASE WHEN NOT allowed THEN 14400.0::DOUBLE END AS retry_after_s FROM walk",
    ),
)
def rate_limit(spark, sf):
    # A few requests a day per client: one token per four hours makes it bite.
    return rq.rate_limit(views.requests(spark, sf), RATE, BURST)


@query(
    "stale_clients",
    with_views(
        "requests_v", recursive=True, extra=WALK,
        query=f"SELECT client, make_timestamp(max(mark)) AS last_refill, (epoch_us({AS_OF_SQL}) - max(mark)) / 1000000 AS idle_s FROM walk GROUP BY client "
        f"HAVING (epoch_us({AS_OF_SQL}) - max(mark)) / 1000000 >= 21600",
    ),
)
def stale_clients(spark, sf):
    return rq.stale_clients(views.requests(spark, sf), views.as_of(), RATE, BURST, idle_s=21_600)


def spoiled_names(spark, sf):
    """Customer and supplier names as ids, some valid, some empty, long or odd."""
    customers = table(spark, sf, "customer").select(F.lit("worker").alias("kind"), F.col("c_custkey").alias("id_key"), F.col("c_name").alias("name"))
    suppliers = table(spark, sf, "supplier").select(F.lit("dataset").alias("kind"), F.col("s_suppkey").alias("id_key"), F.col("s_name").alias("name"))
    both = customers.unionByName(suppliers)
    n = F.col("id_key")
    value = (
        F.when(n % 11 == 0, "")
        .when(n % 7 == 0, F.repeat(F.regexp_replace("name", "#", "."), F.lit(10)))
        .when(n % 3 == 0, F.col("name"))
        .otherwise(F.regexp_replace("name", "#", "-"))
    )
    return both.select("kind", "id_key", value.alias("value"))


@query(
    "validate_ids",
    "SELECT kind, id_key, value, CASE WHEN value = '' THEN 'empty' WHEN strlen(value) > CASE kind WHEN 'worker' THEN 128 ELSE 256 END THEN 'too_long' "
    "WHEN NOT regexp_full_match(value, '[a-zA-Z0-9_.-]+') THEN 'invalid_characters' END AS reason FROM (SELECT kind, id_key, CASE WHEN id_key % 11 = 0 THEN '' "
    "WHEN id_key % 7 = 0 THEN repeat(replace(name, '#', '.'), 10) WHEN id_key % 3 = 0 THEN name ELSE replace(name, '#', '-') END AS value FROM "
    "(SELECT 'worker' AS kind, c_custkey AS id_key, c_name AS name FROM customer UNION ALL SELECT 'dataset', s_suppkey, s_name FROM supplier))",
)
def validate_ids(spark, sf):
    ids = spoiled_names(spark, sf)
    worker = checks.id_reason(F.col("value"), checks.MAX_WORKER_ID)
    dataset = checks.id_reason(F.col("value"), checks.MAX_DATASET_ID)
    return ids.withColumn("reason", F.when(F.col("kind") == "worker", worker).otherwise(dataset))


@query(
    "validate_paths",
    "SELECT page_id, strlen(path) AS path_bytes, CASE WHEN strlen(path) > 4096 THEN 'too_long' WHEN contains(path, '..') THEN 'path_traversal' "
    "WHEN contains(path, chr(0)) THEN 'null_byte' END AS reason FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url || '/../x' "
    "WHEN page_id % 7 = 0 THEN url || chr(0) WHEN page_id % 11 = 0 THEN repeat(url, 200) ELSE url END AS path FROM pages)",
)
def validate_paths(spark, sf):
    n = F.col("page_id")
    path = (
        F.when(n % 5 == 0, F.concat("url", F.lit("/../x")))
        .when(n % 7 == 0, F.concat("url", F.lit("\0")))
        .when(n % 11 == 0, F.repeat("url", F.lit(200)))
        .otherwise(F.col("url"))
    )
    paths = table(spark, sf, "pages").select("page_id", path.alias("path"))
    return paths.select(
        "page_id", F.octet_length("path").cast("bigint").alias("path_bytes"), checks.path_reason(F.col("path")).alias("reason")
    )


@query(
    "validate_metadata",
    "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'too_many_entries' WHEN event_id % 11 = 0 THEN 'key_too_long' "
    "WHEN event_id % 7 = 0 THEN 'value_too_long' END AS reason, CASE WHEN event_id % 13 = 0 THEN 65 ELSE 2 END::BIGINT AS entries FROM events",
)
def validate_metadata(spark, sf):
    n = F.col("event_id")
    many = F.when(n % 13 == 0, F.transform(F.sequence(F.lit(1), F.lit(63)), lambda i: F.concat(F.lit("k"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    key = F.when(n % 11 == 0, F.repeat(F.lit("k"), F.lit(129))).otherwise(F.repeat(F.lit("k"), F.lit(128)))
    value = F.when(n % 7 == 0, F.repeat(F.lit("v"), F.lit(1025))).otherwise(F.repeat(F.lit("v"), F.lit(1024)))
    keys = F.concat(F.array(key, F.lit("event")), many)
    values = F.transform(keys, lambda k: F.when(k == "event", F.col("event_type")).otherwise(value))
    parsed = table(spark, sf, "events").select("event_id", F.map_from_arrays(keys, values).alias("entries"))
    return parsed.select("event_id", checks.metadata_reason(F.col("entries")).alias("reason"), F.size("entries").cast("bigint").alias("entries"))


@query(
    "validate_numbers",
    "SELECT p_partkey, port, balance, CASE WHEN balance < 0 THEN 'negative' WHEN NOT port BETWEEN 1 AND 65535 THEN 'port_out_of_range' END AS reason FROM "
    "(SELECT p_partkey, CAST((p_size - 3) * 1500 AS BIGINT) AS port, CAST(floor(p_retailprice - 1000) AS BIGINT) AS balance FROM part)",
)
def validate_numbers(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_partkey",
        ((F.col("p_size") - 3) * 1500).cast("bigint").alias("port"),
        F.floor(F.col("p_retailprice") - 1000).cast("bigint").alias("balance"),
    )
    reason = F.coalesce(checks.number_reason(F.col("balance")), checks.port_reason(F.col("port")))
    return parts.withColumn("reason", reason)


BLANKS = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


@query(
    "sanitize_text",
    "SELECT page_id, left(c, 1000) AS clean, c AS cleaned, a <> html AS had_brackets, b <> a AS had_scheme, c <> b AS was_trimmed, length(c) > 1000 AS was_cut FROM "
    f"(SELECT *, regexp_replace(b, '^{BLANKS}+|{BLANKS}+$', '', 'g') AS c FROM (SELECT *, regexp_replace(a, 'javascript:', '', 'gi') AS b FROM "
    "(SELECT page_id, html, regexp_replace(html, '[<>]', '', 'g') AS a FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '  JavaScript:' || url || chr(10) ELSE html END AS html FROM pages))))",
)
def sanitize_text(spark, sf):
    text = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("  JavaScript:"), "url", F.lit("\n"))).otherwise(F.col("html"))
    pages = table(spark, sf, "pages").select("page_id", text.alias("html"))
    steps = pages.withColumn("a", checks.without_brackets(F.col("html")))
    steps = steps.withColumn("b", checks.without_scheme(F.col("a"))).withColumn("c", checks.trimmed(F.col("b")))
    return steps.select(
        "page_id",
        checks.sanitized(F.col("html")).alias("clean"),
        F.col("c").alias("cleaned"),
        (F.col("a") != F.col("html")).alias("had_brackets"),
        (F.col("b") != F.col("a")).alias("had_scheme"),
        (F.col("c") != F.col("b")).alias("was_trimmed"),
        (F.length("c") > checks.CLEAN_LENGTH).alias("was_cut"),
    )


@query(
    "sanitize_report",
    "SELECT count(*) AS pages, count(*) FILTER (WHERE contains(html, '<') OR contains(html, '>')) AS with_brackets, "
    "count(*) FILTER (WHERE contains(lower(regexp_replace(html, '[<>]', '', 'g')), 'javascript:')) AS with_scheme FROM pages",
)
def sanitize_report(spark, sf):
    pages = table(spark, sf, "pages").select("html")
    bare = checks.without_brackets(F.col("html"))
    return pages.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(bare != F.col("html")).alias("with_brackets"),
        F.count_if(checks.without_scheme(bare) != bare).alias("with_scheme"),
    )


@query(
    "valid_endpoint",
    "SELECT scheme, count(*) AS urls, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE ok) / count(*) AS valid_share FROM (SELECT "
    "CASE WHEN url LIKE 'http://%' THEN 'http' WHEN url LIKE 'https://%' THEN 'https' WHEN url LIKE 'ftp://%' THEN 'ftp' ELSE 'none' END AS scheme, "
    "url LIKE 'http%' OR (regexp_full_match(url, '[A-Za-z0-9_.-]+:[0-9]{1,5}') AND NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:')) AS ok FROM (SELECT "
    "CASE page_id % 5 WHEN 0 THEN replace(replace(url, 'https:', 'ftp:'), 'http:', 'ftp:') WHEN 1 THEN '10.0.0.' || (page_id % 250) || ':8080' "
    "WHEN 2 THEN 'host-' || page_id || ':50051' ELSE url END AS url FROM pages)) GROUP BY scheme",
)
def valid_endpoint(spark, sf):
    n = F.col("page_id")
    url = (
        F.when(n % 5 == 0, F.regexp_replace("url", "https?:", "ftp:"))
        .when(n % 5 == 1, F.concat(F.lit("10.0.0."), (n % 250).cast("string"), F.lit(":8080")))
        .when(n % 5 == 2, F.concat(F.lit("host-"), n.cast("string"), F.lit(":50051")))
        .otherwise(F.col("url"))
    )
    scheme = F.regexp_extract("url", "^([a-z]+)://", 1)
    urls = table(spark, sf, "pages").select(url.alias("url"))
    report = urls.groupBy(F.when(scheme == "", "none").otherwise(scheme).alias("scheme")).agg(
        F.count(F.lit(1)).alias("urls"), F.count_if(checks.endpoint_valid(F.col("url"))).alias("valid")
    )
    return report.withColumn("valid_share", F.col("valid") / F.col("urls"))


RETRYABLE = "('WorkerHeartbeatTimeout', 'Storage', 'StorageUnavailable', 'CoordinatorUnavailable', 'BarrierTimeout', 'Timeout', 'Grpc')"
DELAY_SQL = (
    "CASE c WHEN 'WorkerHeartbeatTimeout' THEN 1000 WHEN 'Storage' THEN 100 WHEN 'StorageUnavailable' THEN 5000 WHEN 'CoordinatorUnavailable' THEN 2000 "
    "WHEN 'BarrierTimeout' THEN 500 WHEN 'Timeout' THEN 1000 WHEN 'Grpc' THEN 100 END"
)


@query(
    "error_triage",
    f"SELECT c AS error_class, count(*) AS errors, c IN {RETRYABLE} AS retryable, c IN ('CheckpointCorrupted', 'InvalidConfig', 'Internal') AS fatal, "
    f"CAST({DELAY_SQL} AS BIGINT) AS delay_hint_ms, CAST({DELAY_SQL} * count(*) AS BIGINT) AS total_delay_ms FROM "
    f"(SELECT {list(rq.ERROR_CLASSES)!r}[{K} % 24 + 1] AS c FROM events WHERE event_type = 'error') GROUP BY c",
)
def error_triage(spark, sf):
    names = F.array(*[F.lit(n) for n in rq.ERROR_CLASSES])
    errors = table(spark, sf, "events").filter("event_type = 'error'")
    classed = errors.select(F.get(names, (views.prop_k(F.col("props")) % 24).cast("int")).alias("error_class"))
    return rq.error_triage(classed)


@query(
    "latency_histogram",
    with_views(
        "requests_v",
        query="SELECT method, le, count(*) FILTER (WHERE limit_us IS NULL OR latency_us <= limit_us) AS requests FROM requests_v, (VALUES "
        + ", ".join(f"('{b}', {b})" for b in BOUNDS) + ", ('+Inf', NULL)) b(le, limit_us) GROUP BY method, le",
    ),
)
def latency_histogram(spark, sf):
    return rq.latency_histogram(views.requests(spark, sf), BOUNDS)
