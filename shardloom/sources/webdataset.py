"""Tar archives of samples: consecutive members that share a key are one sample.

A first pass reads only the headers of each archive and marks sample borders
about every split size; tasks then read the ranges between borders. The key is
a member's path up to the first dot of its name, the rest is its extension.
"""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.session import settled
from shardloom.sources.containers import qualified
from shardloom.sources.ranges import SPLIT_BYTES, files, store

LONGEST = (1 << 31) - (1 << 20)  # what a column value can hold
BATCH_BYTES = 16 << 20
MEMBER = re.compile(r"((?:.*/)?[^./][^./]*)\.([^/]*)", re.DOTALL)
BORDERS = "path string, start bigint, end bigint, problem string"
SAMPLES = "key string, path string, position bigint, members map<string,binary>, problem string"


def _members(file, start: int, size: int) -> Iterator[tarfile.TarInfo | str]:
    """The members of an archive from a header on; at last what is wrong, if anything."""
    file.seek(start)
    try:
        with tarfile.TarFile(fileobj=file, mode="r") as archive:
            while (member := archive.next()) is not None:
                archive.members = []  # else all of them stay in memory
                if member.offset_data + member.size > size:
                    yield f"{member.name} is cut off by the end of the archive"
                    return
                yield member
    except tarfile.TarError as error:
        if start < size:
            yield f"no archive header after {start}: {error}"


def _split(name: str) -> tuple[str, str] | None:
    found = MEMBER.fullmatch(name)
    return (found[1], found[2].lower()) if found else None


def _borders(split_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for given in batch.to_pylist():
                system, path = store(given["path"])
                begin, key, end = 0, None, 0
                with system.open_input_file(path) as file:
                    for member in _members(file, 0, given["length"]):
                        if isinstance(member, str):
                            rows.append((given["path"], None, None, member))
                            break
                        own = _split(member.name) if member.isfile() else None
                        if own and own[0] != key and member.offset - begin >= split_bytes:
                            rows.append((given["path"], begin, member.offset, None))
                            begin = member.offset
                        key = own[0] if own else key
                        end = member.offset_data + member.size
                if end > begin:
                    rows.append((given["path"], begin, end, None))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "start", "end", "problem"])

    return run


def _samples(wanted: set[str] | None, longest: int):
    kinds = pa.schema([("key", pa.string()), ("path", pa.string()), ("position", pa.int64()), ("members", pa.map_(pa.string(), pa.binary())), ("problem", pa.string())])

    def of(given: dict) -> Iterator[dict]:
        system, path = store(given["path"])
        sample = None
        with system.open_input_file(path) as file:
            for member in _members(file, given["start"], given["end"]):
                if isinstance(member, str) or member.offset >= given["end"]:
                    break
                own = _split(member.name) if member.isfile() else None
                if not own:
                    if member.isfile():
                        yield {"key": None, "path": given["path"], "position": member.offset, "members": [], "problem": f"{member.name} has no key and extension"}
                    continue
                key, extension = own
                if sample is None or sample["key"] != key:
                    if sample is not None:
                        yield sample
                    sample = {"key": key, "path": given["path"], "position": member.offset, "members": [], "problem": None}
                if wanted is not None and extension not in wanted:
                    continue
                fault = None
                if extension in dict(sample["members"]):
                    fault = f"{member.name} is there twice"
                elif member.size > longest:
                    fault = f"{member.name} of {member.size} bytes is more than a value can hold"
                if fault:
                    sample["problem"] = "; ".join(filter(None, [sample["problem"], fault]))
                    continue
                back = file.tell()
                file.seek(member.offset_data)
                sample["members"].append((extension, file.read(member.size)))
                file.seek(back)
        if sample is not None:
            yield sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for given in batch.to_pylist():
                if given["problem"] is not None:
                    rows = [{"key": None, "path": given["path"], "position": None, "members": [], "problem": given["problem"]}]
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    continue
                rows, held = [], 0
                for sample in of(given):
                    rows.append(sample)
                    held += sum(len(v) for _, v in sample["members"])
                    if held > BATCH_BYTES or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return run


def read_webdataset(
    spark: SparkSession, path: str, extensions: Sequence[str] | None = None, split_bytes: int = SPLIT_BYTES, longest: int = LONGEST
) -> DataFrame:
    """(key, path, position, members, problem): the samples of the ``.tar`` files below ``path``.

    ``members`` maps extensions to contents. With ``extensions`` the others are
    skipped unread. Members too long for a value, or there twice, are named in
    ``problem`` instead; a damaged archive gives the samples before the damage
    and a row without a key that tells of it. Archives are not compressed.
    """
    every = files(spark, path, "*.tar")
    count = every.count()
    borders = every.repartition(max(1, count)).mapInArrow(_borders(split_bytes), BORDERS)
    borders = settled(borders, "archive-borders")
    wanted = None if extensions is None else {e.lower() for e in extensions}
    return borders.repartition(max(1, borders.count())).mapInArrow(_samples(wanted, longest), SAMPLES)


def write_webdataset(df: DataFrame, path: str, key: str, members: Sequence[str]) -> DataFrame:
    """One ``.tar`` file a task below ``path``, a sample a row; returns receipts (name, samples, size_bytes).

    ``members`` are columns of text or bytes; their names are the extensions, and
    nulls are left out. Keys need to be free of dots and to differ between
    neighbouring rows. A file gets its name when it is whole and keeps it over
    retries of its task.
    """
    place = qualified(df.sparkSession, path)
    members = list(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        system, root = store(place)
        name = f"shard-{TaskContext.get().partitionId():06d}.tar"
        partial, count, out, archive = f"{root}/_{name}.{uuid.uuid4().hex}", 0, None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", *members)]
            for own, *values in zip(*columns):
                if own is None or "." in own or own.endswith("/"):
                    raise ValueError(f"{own!r} cannot be the key of a sample")
                if archive is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(partial)
                    archive = tarfile.open(fileobj=out, mode="w|", format=tarfile.GNU_FORMAT)
                for extension, value in zip(members, values):
                    if value is not None:
                        entry = tarfile.TarInfo(f"{own}.{extension}")
                        entry.size = len(value)
                        archive.addfile(entry, io.BytesIO(value))
                count += 1
        if archive is not None:
            archive.close()
            size = out.tell()
            out.close()
            system.move(partial, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name], "samples": [count], "size_bytes": [size]})

    given = df.select(F.col(key).cast("string").alias("key"), *[F.col(c).cast("binary").alias(c) for c in members])
    receipts = given.mapInArrow(run, "name string, samples bigint, size_bytes bigint")
    receipts.write.mode("errorifexists").parquet(f"{path}/receipts")
    return df.sparkSession.read.schema(receipts.schema).parquet(f"{path}/receipts")
