"""The literal cases the operators have to reproduce."""

import pytest
from pyspark.sql import functions as F

from shardloom.functions import checks, display, hashing
from shardloom.operators import barriers, checkpoints, chunks, delivery, epochs, manifest, requests, ring, workers
from shardloom.operators.tasks import search_logs
from shardloom.session import small, work_folder

MANIFEST = "dataset_id string, total_samples bigint, shard_size bigint, shuffle boolean, seed bigint, total_shards bigint, path string"


def dataset(spark, total, size, shuffle=True, name="d", seed=42):
    return spark.createDataFrame([(name, total, size, shuffle, seed, -(-total // size), f"/data/{name}")], MANIFEST)


def team(spark, n):
    return spark.createDataFrame([(f"worker-{i}", i) for i in range(n)], "worker_id string, rank bigint")


def one(spark, values, expression):
    df = spark.createDataFrame([(v,) for v in values], f"v {'string' if isinstance(values[0], str) else 'bigint'}")
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


def test_shard_ranges(spark):
    assert manifest.shard_ranges(dataset(spark, 1_281_167, 10_000)).count() == 129
    shards = manifest.shard_ranges(dataset(spark, 1050, 100)).orderBy("shard_id").collect()
    assert len(shards) == 11 and shards[-1].end_index == 1050 and all(s.start_index < s.end_index for s in shards)


def test_coverage_and_audit(spark):
    data = dataset(spark, 60_000, 1000)
    plan = epochs.shard_assignment(data, team(spark, 4), 1)
    loads = epochs.multi_epoch_load(plan).collect()
    assert all(14 <= r.shards <= 16 for r in loads) and sum(r.samples for r in loads) == 60_000
    audit = epochs.assignment_audit(data, plan).first()
    assert (audit.shards, audit.missing_shards, audit.repeated_shards, audit.covered_samples) == (60, 0, 0, 60_000)
    damaged = plan.filter("shard_id <> 7").unionByName(plan.filter("shard_id = 9"))
    audit = epochs.assignment_audit(data, damaged).first()
    assert (audit.missing_shards, audit.repeated_shards, audit.covered_samples) == (1, 1, 59_000)


def test_round_robin_and_no_workers(spark):
    data = dataset(spark, 100_000, 1000)
    order = epochs.epoch_shard_order(epochs.with_epochs(manifest.shard_ranges(data), 1), data)
    turns = epochs.round_robin_assignment(order, team(spark, 4)).groupBy("worker_id").count().collect()
    assert sorted(r["count"] for r in turns) == [25] * 4
    assert epochs.round_robin_assignment(order, team(spark, 4).limit(0)).count() == 0


def test_shuffle_is_reproducible_and_varies(spark):
    def order(epochs_, name="d", seed=42):
        data = dataset(spark, 100, 1, name=name, seed=seed)
        placed = epochs.epoch_shard_order(epochs.with_epochs(manifest.shard_ranges(data), epochs_), data)
        return {e: [r.shard_id for r in placed.filter(F.col("epoch") == e).orderBy("order_index").collect()] for e in range(epochs_)}

    first = order(2)
    assert first == order(2) and first[0] != first[1] and sorted(first[0]) == list(range(100))
    assert order(1, name="other")[0] != first[0] and order(1, seed=7)[0] != first[0]


def test_ring(spark):
    keys = spark.range(100).select(F.concat(F.lit("key-"), "id").alias("k"))
    three = team(spark, 3)
    before = ring.ring_lookup(keys, ring.hash_ring(three), "k").withColumnRenamed("worker_id", "old")
    after = ring.ring_lookup(keys, ring.hash_ring(three.filter("rank <> 1")), "k")
    kept = before.join(after, "k").filter("old <> 'worker-1'")
    assert kept.count() > 0 and kept.filter("old <> worker_id").count() == 0
    named = spark.createDataFrame([("worker-1", 1), ("worker-2", 2), ("worker-3", 3)], "worker_id string, rank bigint")
    shards = manifest.shard_ranges(dataset(spark, 1000, 1, name="dataset-1"))
    for kind in ("fnv", "md5"):
        placed = ring.ring_assignment(shards, ring.hash_ring(named, hash=kind), hash=kind)
        counts = [r.shards for r in ring.ring_counts(placed, named).collect()]
        assert sum(counts) == 1000 and all(abs(n - 333) <= 166 for n in counts), (kind, counts)
    empty = ring.ring_lookup(keys, ring.hash_ring(three.limit(0)), "k")
    assert empty.filter("worker_id is null").count() == 100
    twice = ring.ring_members(ring.hash_ring(three.unionByName(three)))
    assert sorted((r.worker_id, r.points) for r in twice.collect()) == [(f"worker-{i}", 150) for i in range(3)]


def test_ring_lookup_shuffled_equals_broadcast(spark):
    keys = spark.range(500).select(F.col("id").cast("string").alias("k"))
    points = ring.hash_ring(team(spark, 5))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(ring.ring_lookup(keys, points, "k", broadcast_arcs=False)) == rows(ring.ring_lookup(keys, points, "k", bits=3))


def test_fnv_against_the_definition(spark):
    def plain(text):
        state = hashing.FNV_OFFSET
        for code in text.encode() + bytes([255]):
            state = (state ^ code) * hashing.FNV_PRIME % 2**64
        return state - 2**63

    words = ["a", "", "worker-1:3", "é:9", "x" * 300]
    assert one(spark, words, hashing.fnv1a64) == [plain(w) for w in words]


def test_rebalance_after_a_worker_left(spark):
    data = dataset(spark, 1000, 100)
    log = spark.createDataFrame([], "dataset_id string, op string, epoch bigint, ts timestamp_ntz, event_id bigint")
    rest = workers.compact_ranks(team(spark, 3).drop("rank"), spark.createDataFrame([("worker-1",)], "worker_id string"))
    plan = epochs.rebalance(data, rest, log)
    assert plan.select("worker_id").distinct().count() == 2 and plan.select("shard_id").distinct().count() == 10


def test_ranks_are_packed_in_text_order(spark):
    many = spark.createDataFrame([("worker-2",), ("worker-10",), ("worker-1",)], "worker_id string")
    packed = workers.compact_ranks(many, many.limit(0)).orderBy("rank").collect()
    assert [r.worker_id for r in packed] == ["worker-1", "worker-10", "worker-2"]


def notices(spark, steps):
    rows = [(f"c{s}-{i}", s, 1, "w", f"/p/{s}", 10, i, {"worker_id": "old", "k": "v"}) for i, s in enumerate(steps)]
    df = spark.createDataFrame(
        rows, "checkpoint_id string, step bigint, epoch bigint, worker_id string, path string, size_bytes bigint, notification bigint, metadata map<string,string>"
    )
    return df.withColumn("notified_at", F.lit("2024-01-01").cast("timestamp_ntz"))


def test_retention_and_recovery(spark):
    catalogue = checkpoints.checkpoint_catalogue(notices(spark, range(0, 1000, 100)))
    assert sorted(r.step for r in checkpoints.retain_checkpoints(catalogue).collect()) == [500, 600, 700, 800, 900]
    assert sorted(r.step for r in checkpoints.eviction_plan(catalogue).collect()) == [0, 100, 200, 300, 400]
    point = checkpoints.recovery_point(checkpoints.checkpoint_catalogue(notices(spark, [100]))).first()
    assert point.has_checkpoint and point.resume_step == 100
    none = checkpoints.recovery_plan(catalogue.limit(0), dataset(spark, 100, 10), team(spark, 2), "worker-0").collect()
    assert len(none) == 1 and not none[0].has_checkpoint and none[0].resume_step == 0 and none[0].shard_id is None


def test_catalogue_last_notice_wins(spark):
    kept = checkpoints.checkpoint_catalogue(notices(spark, [5, 5, 5])).first()
    assert kept.checkpoint_id == "c5-2" and kept.overwritten == 2 and kept.metadata == {"k": "v", "worker_id": "w"}


def test_step_policy(spark):
    steps = spark.range(50).select(F.col("id").alias("step"))
    assert [r.step for r in checkpoints.due_by_steps(steps, 10).orderBy("step").collect()] == [10, 20, 30, 40]


def test_delta_round_trip_with_nulls(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, None, 3)], "k int, s string, n int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "d", 4)], "k int, s string, n int")
    delta = checkpoints.table_delta(old, new, ["k"])
    assert sorted((r.k, r.op) for r in delta.collect()) == [(2, "update"), (3, "delete"), (4, "insert")]
    assert sorted(map(repr, checkpoints.apply_delta(old, delta, ["k"]).collect())) == sorted(map(repr, new.collect()))


def test_delta_with_a_null_key(spark):
    old = spark.createDataFrame([(None, "a"), (1, "b")], "k int, s string")
    new = spark.createDataFrame([(None, "a"), (2, None)], "k int, s string")
    assert checkpoints.table_delta(old, old, ["k"]).count() == 0
    delta = checkpoints.table_delta(old, new, ["k"])
    assert sorted((r.k, r.op) for r in delta.collect()) == [(1, "delete"), (2, "insert")]
    assert sorted(map(repr, checkpoints.apply_delta(old, delta, ["k"]).collect())) == sorted(map(repr, new.collect()))
    gone = checkpoints.table_delta(old, old.filter("k = 1"), ["k"])
    assert [tuple(r) for r in checkpoints.apply_delta(old, gone, ["k"]).collect()] == [(1, "b")]


def test_barrier_releases_at_the_third(spark):
    calls = spark.createDataFrame([("b", f"w{i}", i) for i in range(4)], "barrier_id string, worker_id string, event_id bigint")
    calls = calls.withColumn("ts", F.timestamp_seconds("event_id").cast("timestamp_ntz"))
    got = barriers.barrier_arrivals(calls, 3).orderBy("event_id").collect()
    assert [(r.generation, r.arrival_order, r.released) for r in got] == [(0, 1, True), (0, 2, True), (0, 3, True), (1, 1, False)]
    late = barriers.barrier_timeouts(barriers.barrier_wait(barriers.barrier_arrivals(calls, 3)), F.lit("1970-01-01 00:05:04").cast("timestamp_ntz"))
    assert [r.event_id for r in late.collect()] == [3]


def test_rate_limit_burst(spark):
    calls = spark.range(6).select(F.lit("c").alias("client"), F.col("id").alias("event_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"))
    got = requests.rate_limit(calls, 10.0, 5).orderBy("event_id").collect()
    assert [r.allowed for r in got] == [True] * 5 + [False] and got[5].retry_after_s == 0.1


def test_ids_and_paths(spark):
    ids = ["worker-1", "gpu_node_0", "node.cluster.local", "", "worker/1", "worker<script>", "worker-1\n", "x" * 129]
    want = [None, None, None, "empty", "invalid_characters", "invalid_characters", "invalid_characters", "too_long"]
    assert one(spark, ids, lambda c: checks.id_reason(c, checks.MAX_WORKER_ID)) == want
    paths = ["/data/training", "s3://bucket/key", "/data/../etc/passwd", "/a\0b", "é" * 2049]
    assert one(spark, paths, checks.path_reason) == [None, None, "path_traversal", "null_byte", "too_long"]


def test_sanitize_and_endpoints(spark):
    texts = ['<script>alert("xss")</script>', "javascript:alert(1)", "  hello  ", "a" * 2000, " ﻿x\n"]
    assert one(spark, texts, checks.sanitized) == ['scriptalert("xss")/script', "alert(1)", "hello", "a" * 1000, "x"]
    urls = ["http://10.0.0.1:8080", "https://c.example.com:443", "10.0.0.1:8080", "not-a-url", "ftp://invalid.com", "localhost:50051"]
    assert one(spark, urls, checks.endpoint_valid) == [True, True, True, False, False, False]


def test_display(spark):
    assert one(spark, [0, 1024, 1536, 1024**2, 2621440, 1024**3, 5 * 1024**4], display.format_bytes) == ["0 B", "1 KB", "1.5 KB", "1 MB", "2.5 MB", "1 GB", "5 TB"]
    assert one(spark, [100, 999, 1000, 1500, 10000, 1_000_000, 1_500_000], display.format_number) == ["100", "999", "1.0K", "1.5K", "10.0K", "1.0M", "1.5M"]
    assert one(spark, [5000, 60000, 90000, 3600000, 5400000], display.format_duration) == ["5s", "1m 0s", "1m 30s", "1h 0m", "1h 30m"]
    assert one(spark, [10, 5000, 120_000, 7_200_000], display.relative_time) == ["just now", "5s ago", "2m ago", "2h ago"]


def test_error_classes():
    facts = requests.ERROR_CLASSES
    assert facts["CoordinatorUnavailable"] == (True, False, 2000) and not facts["CheckpointCorrupted"][0]
    assert facts["InvalidConfig"][1] and not facts["Timeout"][1]


def test_states(spark):
    codes = spark.createDataFrame([(None,), (0,), (4,), (99,)], "c int")
    assert [r[0] for r in codes.select(workers.decode_state(F.col("c"))).collect()] == ["IDLE", "INITIALIZING", "TRAINING", "INITIALIZING"]


def test_registry_refuses_repeats_and_overflow(spark):
    log = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "worker_id string, event_id bigint")
    log = log.withColumn("ts", F.timestamp_seconds("event_id").cast("timestamp_ntz"))
    got = workers.register_workers(log, max_workers=2).orderBy("event_id").collect()
    assert [(r.accepted, r.reason, r.rank) for r in got] == [
        (True, None, 0), (False, "already_registered", None), (True, None, 1), (False, "max_workers_reached", None),
    ]


def test_a_full_registry_refuses_known_ids_as_full(spark):
    log = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", 4), ("c", 5), ("b", 6)], "worker_id string, event_id bigint")
    log = log.withColumn("ts", F.timestamp_seconds("event_id").cast("timestamp_ntz"))
    got = workers.register_workers(log, max_workers=2).orderBy("event_id").collect()
    full = "max_workers_reached"
    assert [r.reason for r in got] == [None, "already_registered", None, full, full, full]


def test_buckets_age_by_their_last_refill(spark):
    # One token in 10 s; asking every second refills at 10, 20, ... only.
    calls = spark.range(26).select(F.lit("c").alias("client"), F.col("id").alias("event_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"))
    got = requests.stale_clients(calls, F.lit("1970-01-01 00:05:20").cast("timestamp_ntz"), 0.1, 5).collect()
    assert [(str(r.last_refill), r.idle_s) for r in got] == [("1970-01-01 00:00:20", 300.0)]


def test_liveness_is_strict(spark):
    beats = spark.createDataFrame([("a", "TRAINING"), ("b", "TRAINING")], "worker_id string, state string")
    beats = beats.withColumn("ts", F.when(F.col("worker_id") == "a", "2024-01-01 00:00:00").otherwise("2023-12-31 23:59:59").cast("timestamp_ntz"))
    dead = workers.dead_workers(beats, F.lit("2024-01-01 00:00:30").cast("timestamp_ntz"))
    assert [r.worker_id for r in dead.collect()] == ["b"]


@pytest.mark.parametrize("size", [0, 1, 6, 7, 8, 1000])
def test_chunks_round_trip_and_missing_chunk(spark, size):
    data = bytes(i % 251 for i in range(size))
    df = spark.createDataFrame([(1, bytearray(data))], "id int, payload binary")
    cut = chunks.chunk_payload(df, "payload", 7)
    back = chunks.reassemble(chunks.map_chunks(chunks.map_chunks(cut, b"key-1"), b"key-1"), "id").collect()
    assert bytes(back[0].payload) == data and back[0].complete
    if cut.count() > 1:
        lost = chunks.reassemble(cut.filter("offset > 0"), "id").first()
        assert not lost.complete and lost.payload is None


def test_search_is_case_blind(spark):
    logs = spark.createDataFrame([("Epoch DONE", "Trainer", "info"), ("x", "done-source", "warn")], "message string, source string, level string")
    assert search_logs(logs, "Done").count() == 2
    assert search_logs(logs, "done", level="info").count() == 1


def test_small_keeps_large_tables_unhinted(spark):
    assert "ResolvedHint" in small(spark.range(10), 10)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in small(spark.range(11), 10)._jdf.queryExecution().analyzed().toString()


def test_sharded_files(spark):
    path = work_folder(spark, "cases")
    data = delivery.shard_samples(spark.range(1050).select("id"), ["id"], 100)
    delivery.write_sharded(data, path)
    files = delivery.shard_files(spark, path).collect()
    assert len(files) == 11 and all(len(f.file_paths) == 1 for f in files) and sum(f.num_samples for f in files) == 1050


class Settings:
    """A session without ``spark.checkpoint.dir``."""

    def __init__(self, spark, master):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})()
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()


def test_work_folder_without_a_setting(spark):
    first, second = (work_folder(Settings(spark, "local[2]"), "x") for _ in range(2))
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
    with pytest.raises(ValueError):
        work_folder(Settings(spark, "spark://host:7077"), "x")


def test_reports_on_writes_that_were_not_pending(spark):
    rows = [("a", "Completed", 1, 1), ("a", "Pending", 2, 2), ("a", "Failed", 3, 3), ("b", "InProgress", 1, 4), ("b", "Failed", 2, 5), ("c", "Pending", 1, 6), ("c", "Completed", 1, 7)]
    events = spark.createDataFrame(rows, "checkpoint_id string, status string, ts int, event_id int")
    assert {r.checkpoint_id: r.status for r in checkpoints.unknown_writes(events).collect()} == {"a": "Completed", "b": "Failed"}
