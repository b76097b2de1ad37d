"""Container files: layout, round trip and damaged files."""

import struct
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import functions as F

import shardloom.session as session_module
from shardloom.session import work_folder
from shardloom.sources import containers


def expected(step, epoch, kind, notes, data):
    head = b"CKPT" + struct.pack("<IQQBBQI", 1, step, epoch, kind, 0, len(data), len(notes))
    return head + notes + data


def test_layout_and_round_trip(spark):
    data = bytes(range(250)) * 4
    df = spark.createDataFrame([("a.ckpt", 100, 1, bytearray(data))], "name string, step bigint, epoch bigint, data binary")
    notes = F.create_map(F.lit("k"), F.lit("é"))
    made = df.select("name", containers.container(F.col("step"), F.col("epoch"), F.lit(0), notes, F.col("data")).alias("content"))
    assert bytes(made.first().content) == expected(100, 1, 0, '{"k":"é"}'.encode(), data)
    path = work_folder(spark, "containers")
    receipt = containers.encode_checkpoint(made, path).first()
    assert receipt.size_bytes > 1000
    back = containers.scan_checkpoints(spark, path).first()
    assert bytes(back.data) == data and back.metadata == {"k": "é"} and (back.step, back.epoch) == (100, 1)
    assert back.version_ok and back.size_ok and not back.is_corrupt and not back.compressed


def test_damaged_files(spark):
    good = expected(7, 2, 1, b"{}", b"abc")
    files = [
        ("good", good),
        ("magic", b"XXXX" + good[4:]),
        ("version", good[:4] + struct.pack("<I", 9) + good[8:]),
        ("cut", good[:-2]),
        ("header", good[:20]),
        ("huge", good[:8] + b"\xff" * 8 + good[16:]),
    ]
    path = work_folder(spark, "containers")
    containers.encode_checkpoint(spark.createDataFrame([(n, bytearray(c)) for n, c in files], "name string, content binary"), path)
    got = {r.name: r for r in containers.scan_checkpoints(spark, path).collect()}
    assert [n for n in got if got[n].is_corrupt] == sorted(["magic", "header"], key=list(got).index)
    assert not got["version"].version_ok and not got["version"].is_corrupt
    assert not got["cut"].size_ok and got["good"].size_ok and got["huge"].step is None
    headers = {r.name: r for r in containers.scan_headers(spark, path).collect()}
    fields = ["file_size", "is_corrupt", "version", "version_ok", "step", "epoch", "type", "compressed", "data_size", "size_ok", "metadata"]
    for name, whole in got.items():
        assert [headers[name][f] for f in fields] == [whole[f] for f in fields]
    assert {r.name for r in containers.read_chunks(spark, path, 2).collect()} == {"good", "version", "huge"}


def test_chunks_of_large_containers(spark):
    """A container of 200 MB from chunks, an empty one, one without chunks; the scan reads headers only."""
    heads = spark.createDataFrame(
        [(n, 5, 1, 0, {"k": n}) for n in ("large", "empty", "bare")], "name string, step bigint, epoch bigint, kind int, metadata map<string,string>"
    )
    body = spark.range(200).select(
        F.lit("large").alias("name"), F.col("id").alias("chunk"), F.encode(F.repeat(F.char(65 + F.col("id") % 26), F.lit(1_000_003)), "UTF-8").alias("data")
    )
    odd = spark.createDataFrame([("empty", 0, None), ("unknown", 0, bytearray(b"x"))], body.schema)
    path = work_folder(spark, "containers")
    receipts = {r.name: r.size_bytes for r in containers.write_chunks(heads, body.union(odd).repartition(7), path).collect()}
    assert receipts["large"] == 38 + len('{"k":"large"}') + 200 * 1_000_003 and set(receipts) == {"large", "empty", "bare"}
    scanned = {r.name: r for r in containers.scan_headers(spark, path).collect()}
    assert all(r.size_ok and not r.is_corrupt and r.metadata == {"k": n} for n, r in scanned.items())
    assert {n: r.data_size for n, r in scanned.items()} == {"large": 200 * 1_000_003, "empty": 0, "bare": 0}
    back = containers.read_chunks(spark, path, 1_000_003).select("name", "chunk", "offset", F.md5("data").alias("m"), F.length("data").alias("n"))
    want = body.select("name", "chunk", (F.col("chunk") * 1_000_003).alias("offset"), F.md5("data").alias("m"), F.length("data").alias("n"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))


def test_writers_hold_few_bytes_of_what_they_write(spark, tmp_path, monkeypatch):
    """However many contents a task writes, it is handed a few MB at once."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    many = spark.range(0, 64, 1, 1).select(F.concat(F.lit("c"), "id").alias("name"), F.expr("encode(repeat('x', 1000000), 'UTF-8')").alias("content"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    seen = []

    @contextmanager
    def watched(session, max_bytes):
        with session_module.batches_of(session, max_bytes):
            seen.append(max(r.n for r in many.mapInArrow(sizes, "n long").collect()))
            yield

    monkeypatch.setattr(containers, "batches_of", watched)
    receipts = containers.encode_checkpoint(many, str(tmp_path / "a"))
    assert receipts.count() == 64 and receipts.filter("size_bytes <> 1000000").isEmpty()
    heads = spark.createDataFrame([("big", 1, 1, 1, {"a": "b"})], "name string, step long, epoch long, kind int, metadata map<string,string>")
    chunks = many.select(F.lit("big").alias("name"), F.monotonically_increasing_id().alias("chunk"), F.col("content").alias("data"))
    assert containers.write_chunks(heads, chunks, str(tmp_path / "b")).first().size_bytes > 64_000_000
    assert len(seen) == 2 and max(seen) < 12 << 20
    assert spark.conf.get(setting) == before
    for own in ("3m", "1g"):
        spark.conf.set(setting, own)
        with session_module.batches_of(spark, 8 << 20):
            assert spark.conf.get(setting) == ("3m" if own == "3m" else f"{8 << 20}b")
        assert spark.conf.get(setting) == own
    spark.conf.set(setting, before)
