"""Record files and archives: round trips, splits and damage."""

import datetime
import io
import os
import struct
import tarfile

import numpy as np
import pyarrow as pa
import pytest

from shardloom.functions.checksums import crc32c, masked_crc32c
from shardloom.session import work_folder
from shardloom.sources import tfrecord, webdataset
from shardloom.sources.tables import load

SCHEMA = "a bigint, b string, c double, d float, e boolean, f date, g timestamp_ntz, h binary, i array<bigint>, j array<string>, k array<float>"
ROWS = [
    (1, "x", 0.1, 0.5, True, datetime.date(2024, 2, 29), datetime.datetime(2024, 1, 2, 3, 4, 5, 678901), bytearray(b"\0\xff"), [1, -2, 3], ["é", ""], [1.5]),
    (-(1 << 63), "", -1e300, -0.0, False, datetime.date(1960, 1, 1), datetime.datetime(1950, 1, 1), bytearray(b""), [], [], []),
    (None,) * 11,
    ((1 << 63) - 1, "z" * 5000, float("inf"), 3.0, None, None, None, bytearray(os.urandom(3000)), list(range(300)), None, None),
]


def record(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))

    def crc(b):
        return int(masked_crc32c(np.frombuffer(b, np.uint8), [0], [len(b)])[0]).to_bytes(4, "little")

    return head + crc(head) + data + crc(data)


def example(n: int, text: str) -> bytes:
    return tfrecord.encoded({"n": (3, [n]), "t": (1, [text.encode()])})


def put(path, content: bytes, name="part-0.tfrecord"):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "wb") as out:
        out.write(content)


def local(spark, name):
    return work_folder(spark, name).removeprefix("file:")


def plain(rows):
    return sorted(repr([bytes(v) if isinstance(v, bytearray) else v for v in r]) for r in rows)


def test_checksums():
    data = np.frombuffer(b"123456789" + bytes(range(256)) * 9, np.uint8)
    assert int(crc32c(data, [0], [9])[0]) == 0xE3069283
    assert int(crc32c(np.zeros(32, np.uint8), [0], [32])[0]) == 0x8A9136AA
    one = [int(crc32c(data, [a], [b])[0]) for a, b in ((0, 0), (3, 200), (5, 1900), (0, len(data)))]
    assert crc32c(data, [0, 3, 5, 0], [0, 200, 1900, len(data)]).tolist() == one


def test_round_trip_of_all_types(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = work_folder(spark, "types")
    receipts = tfrecord.write_tfrecord(df.repartition(3), path)
    assert receipts.agg({"records": "sum"}).first()[0] == len(ROWS)
    assert plain(load(spark, "tfrecord", path, df.schema).collect()) == plain(ROWS)
    some = load(spark, "tfrecord", path, "i array<bigint>, b string")
    assert some.columns == ["i", "b"] and plain(some.collect()) == plain([(r[8], r[1]) for r in ROWS])


@pytest.mark.parametrize("split", [None, 1 << 20, 1000, 37])
def test_ranges_of_any_size_give_each_record_once(spark, split):
    path = local(spark, "splits")
    rows = [(k, "t" * (k * 7 % 400)) for k in range(150)]
    put(path, b"".join(record(example(*r)) for r in rows))
    got = load(spark, "tfrecord", path, "n bigint, t string", split_bytes=split)
    assert sorted(map(tuple, got.collect())) == rows
    if split == 1000:
        assert got.rdd.getNumPartitions() > 20


@pytest.mark.parametrize("split", [None, 64])
def test_damage_costs_only_the_records_it_covers(spark, split):
    path = local(spark, "damage")
    parts = [record(example(k, "word " * 20)) for k in range(12)]
    spoiled = bytearray(parts[3])
    spoiled[40] ^= 1  # data
    parts[3] = bytes(spoiled)
    spoiled = bytearray(parts[6])
    spoiled[2] ^= 1  # length
    parts[6] = bytes(spoiled)
    parts[9] = record(b"\x0b\xff")  # sound, but no example
    put(path, b"".join(parts) + record(example(99, "cut"))[:-3])
    got = load(spark, "tfrecord", path, "n bigint, _corrupt_record string", split_bytes=split).collect()
    assert sorted(r.n for r in got if r.n is not None) == [0, 1, 2, 4, 5, 7, 8, 10, 11]
    faults = sorted(r._corrupt_record.split(": ", 1)[1] for r in got if r._corrupt_record)
    assert len(faults) == 4 and faults[0].startswith("cut off") and sum("checksum" in f for f in faults) == 2
    left = load(spark, "tfrecord", path, "n bigint", mode="DROPMALFORMED", split_bytes=split)
    assert left.count() == 9
    with pytest.raises(Exception, match="checksum|cut off|example"):
        load(spark, "tfrecord", path, "n bigint").collect()


def test_records_longer_than_a_window(monkeypatch, tmp_path):
    monkeypatch.setattr(tfrecord, "WINDOW", 64)
    bodies = [os.urandom(n) for n in (0, 1, 30, 70, 500, 5, 52, 48)]
    content = b"".join(map(record, bodies))
    put(str(tmp_path), content)
    for step in (len(content), 50, 7):
        got = []
        for low in range(0, len(content), step):
            chain = tfrecord._Chain(f"file:{tmp_path}/part-0.tfrecord", len(content))
            got += [d for _, d, fault in chain.records(low, min(low + step, len(content))) if fault is None]
        assert got == bodies


def test_search_for_a_start_takes_few_checksums(monkeypatch, tmp_path):
    content = b"".join(record(example(n, "t" * (2000 + n % 300))) for n in range(1200))
    put(str(tmp_path), content)
    chain, taken = tfrecord._Chain(f"file:{tmp_path}/part-0.tfrecord", len(content)), []
    monkeypatch.setattr(tfrecord, "masked_crc32c", lambda data, start, end: taken.append(len(start)) or masked_crc32c(data, start, end))
    at = chain.next_start(1 << 20, len(content))
    assert sum(taken) < 5000  # before, every place up to the end of the range
    assert at in {place for place, _, _ in chain.records(0, 2 << 20)} and at - (1 << 20) < 3000


def test_written_batches_equal_encoded_rows():
    kinds = {"a": "bigint", "s": "string", "b": "binary", "f": "float", "d": "double", "o": "boolean", "ü": "date"}
    numbers = [0, 1, 127, 128, -1, -(1 << 63), (1 << 63) - 1, None]
    rows = 200
    batch = pa.RecordBatch.from_pydict(
        {
            "a": pa.array([numbers[k % 8] for k in range(rows)], pa.int64()),
            "s": pa.array([None if k % 5 == 0 else "é" * (k * k % 700) for k in range(rows)]),
            "b": pa.array([None if k % 7 == 0 else bytes([k]) * (k % 140) for k in range(rows)], pa.binary()),
            "f": pa.array([None if k % 3 == 0 else k / 7 for k in range(rows)], pa.float32()),
            "d": pa.array([None if k % 4 == 0 else -k / 3 for k in range(rows)], pa.float64()),
            "o": pa.array([None if k % 6 == 0 else k % 2 == 0 for k in range(rows)]),
            "ü": pa.array([None if k % 9 == 0 else -k for k in range(rows)], pa.int32()),
        }
    )
    writers = {n: tfrecord._to_feature(k) for n, k in kinds.items()}
    for part in (batch, batch.slice(13, 101), batch.slice(0, 1), batch.slice(0, 0)):
        want = [record(tfrecord.encoded({n: None if v is None else writers[n]([v]) for n, v in row.items()})) for row in part.to_pylist()]
        assert tfrecord._record_bytes(part, kinds).tobytes() == b"".join(want)


def test_empty_files_and_folders(spark):
    path = local(spark, "none")
    put(path, b"")
    assert load(spark, "tfrecord", path, "n bigint").collect() == []
    assert load(spark, "webdataset", path).collect() == []
    with pytest.raises(ValueError):
        load(spark, "tfrecord", path)


def archive(members, longname=False) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT if longname else tarfile.GNU_FORMAT) as tar:
        for name, content in members:
            entry = tarfile.TarInfo(name)
            if content is None:
                entry.type = tarfile.DIRTYPE
                tar.addfile(entry)
            else:
                entry.size = len(content)
                tar.addfile(entry, io.BytesIO(content))
    return out.getvalue()


@pytest.mark.parametrize("split", [1, 3000, 1 << 30])
@pytest.mark.parametrize("longname", [False, True])
def test_samples_stay_whole_over_splits(spark, split, longname):
    path = local(spark, "tars")
    deep = "d/" * (80 if longname else 1)
    want = {}
    for part in range(2):
        members = [("d/", None)]
        for k in range(40):
            key = f"{deep}s{part}-{k}"
            content = {"txt": f"text {k} é".encode() * (k % 5), "seg.PNG": os.urandom(k * 13)}
            want[key] = {e.lower(): c for e, c in content.items()}
            members += [(f"{key}.{e}", c) for e, c in content.items()]
        put(path, archive(members, longname), f"a-{part}.tar")
    rows = webdataset.read_webdataset(spark, path, split_bytes=split).collect()
    assert {r.key: {e: bytes(c) for e, c in r.members.items()} for r in rows} == want and len(rows) == len(want)
    text = webdataset.read_webdataset(spark, path, ["TXT"], split_bytes=split).collect()
    assert {r.key: list(r.members) for r in text} == {k: ["txt"] for k in want}


def test_members_that_cannot_be_values_are_named(spark):
    path = local(spark, "odd")
    put(path, archive([("a.txt", b"1"), ("a.txt", b"2"), ("b.bin", b"x" * 100), ("b.txt", b"3"), ("README", b"no key"), ("c.txt", b"4")]), "x.tar")
    whole = archive([("k.txt", b"5"), ("l.txt", b"6" * 5000)])
    put(path, whole[:3000], "y.tar")
    put(path, b"not an archive" * 100, "z.tar")
    rows = webdataset.read_webdataset(spark, path, longest=50).collect()
    got = {r.key: ({e: bytes(c) for e, c in r.members.items()}, r.problem) for r in rows if r.key}
    assert got["a"] == ({"txt": b"1"}, "a.txt is there twice") and got["c"] == ({"txt": b"4"}, None)
    assert got["b"][0] == {"txt": b"3"} and "b.bin of 100 bytes" in got["b"][1] and got["k"] == ({"txt": b"5"}, None)
    told = " | ".join(sorted(r.problem for r in rows if not r.key))
    assert "README" in told and "l.txt is cut off" in told and "z.tar" not in told and "no archive header" in told


def test_written_archives_read_back(spark):
    rows = [(f"k{i}", None if i % 7 == 0 else f"text {i}", bytearray(os.urandom(i))) for i in range(60)]
    path = work_folder(spark, "written")
    receipts = webdataset.write_webdataset(spark.createDataFrame(rows, "id string, txt string, bin binary").repartition(4), path, "id", ["txt", "bin"])
    assert receipts.count() == 4 and receipts.agg({"samples": "sum"}).first()[0] == 60
    got = {r.key: {e: bytes(c) for e, c in r.members.items()} for r in load(spark, "webdataset", path).collect()}
    assert got == {k: {**({"txt": t.encode()} if t is not None else {}), "bin": bytes(b)} for k, t, b in rows}
    with pytest.raises(Exception, match="cannot be the key"):
        webdataset.write_webdataset(spark.createDataFrame([("a.b", "t")], "id string, txt string"), work_folder(spark, "bad"), "id", ["txt"])
