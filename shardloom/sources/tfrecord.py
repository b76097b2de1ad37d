"""Record files with checksums, holding one example message per record.

A file is a chain of records: length (8 bytes, little endian), its masked
CRC-32C, the data, and the masked CRC-32C of the data. A range of a file begins
with the first place where a length and data fit their checksums; a record
belongs to the range it starts in. So one large file is read by many tasks and a
damaged place costs the records it covers.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from shardloom.functions.checksums import masked_crc32c
from shardloom.sources.containers import qualified
from shardloom.sources.ranges import SPLIT_BYTES, file_ranges, store

# Sizes around the data, and wire types and field numbers of the message.
HEAD, TAIL = 12, 4
VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5
CORRUPT = "_corrupt_record"
WINDOW = 8 << 20
SCAN = 64 << 10  # what a search for a start looks at first
SHORT = 512  # values up to here are copied side by side
LONGEST = (1 << 31) - (1 << 20)  # what a column value can hold
BATCH_BYTES = 16 << 20
WRITTEN = 4 << 20
WHOLE = {"tinyint", "smallint", "int", "bigint", "boolean", "date", "timestamp", "timestamp_ntz"}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(number, wire type, value or start, end) of each field of a message."""
    while at < end:
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == VARINT:
            value, at = _varint(data, at)
            yield number, wire, value, at
        elif wire == BYTES:
            size, at = _varint(data, at)
            if at + size > end:
                raise ValueError("a field runs past its message")
            yield number, wire, at, at + size
            at += size
        elif wire in (FIXED32, FIXED64):
            size = 4 if wire == FIXED32 else 8
            yield number, wire, at, at + size
            at += size
        else:
            raise ValueError(f"wire type {wire}")


def _values(data: bytes, start: int, end: int) -> list:
    """The list in a feature: bytes, floats or whole numbers."""
    out: list = []
    for kind, _, low, high in _fields(data, start, end):
        for number, wire, a, b in _fields(data, low, high):
            if number != 1:
                continue
            if kind == 1:
                out.append(data[a:b])
            elif kind == 2:
                out.extend(struct.unpack_from(f"<{(b - a) // 4}f", data, a))
            elif wire == VARINT:
                out.append(a - (1 << 64) if a >> 63 else a)
            else:
                while a < b:
                    value, a = _varint(data, a)
                    out.append(value - (1 << 64) if value >> 63 else value)
    return out


def decoded(data: bytes, wanted: set[str]) -> dict[str, list]:
    """The wanted features of an example message by name."""
    out = {}
    for number, wire, start, end in _fields(data, 0, len(data)):
        if number != 1 or wire != BYTES:
            continue
        for n, _, low, high in _fields(data, start, end):
            name, value = None, None
            for m, _, a, b in _fields(data, low, high) if n == 1 else ():
                if m == 1:
                    name = data[a:b].decode()
                elif m == 2:
                    value = (a, b)
            if name in wanted and value is not None:
                out[name] = _values(data, *value)
    return out


def _number(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _message(number: int, body: bytes) -> bytes:
    return _number(number << 3 | BYTES) + _number(len(body)) + body


@lru_cache(1 << 14)
def _lead(number: int, size: int) -> bytes:
    """What stands before so many bytes of a message."""
    return _number(number << 3 | BYTES) + _number(size)


@lru_cache(1 << 14)
def _entry_lead(name: str, kind: int, size: int) -> bytes:
    """What stands before so many bytes of a feature's values: entry, name, value."""
    key, value = _message(1, name.encode()), _lead(kind, size)
    value = _lead(2, len(value) + size) + value
    return _lead(1, len(key) + len(value) + size) + key + value


def encoded(row: dict[str, tuple[int, list] | None]) -> bytes:
    """An example message; features are (1 bytes, 2 floats, 3 whole numbers; values), null ones stay out."""
    entries = []
    for name, feature in row.items():
        if feature is None:
            continue
        kind, values = feature
        if kind == 1:
            body = b"".join([_lead(1, len(v)) + v for v in values])
        else:
            body = struct.pack(f"<{len(values)}f", *values) if kind == 2 else b"".join(map(_number, values))
            body = _lead(1, len(body)) + body
        entries.append(_entry_lead(name, kind, len(body)) + body)
    return _message(1, b"".join(entries))


def _to_feature(kind: str):
    """A column's value to a feature, by its type."""
    if kind in WHOLE:
        return lambda values: (3, [int(v) for v in values])
    if kind == "float":
        return lambda values: (2, values)
    if kind == "double":
        return lambda values: (1, [struct.pack("<d", v) for v in values])
    if kind == "string":
        return lambda values: (1, [v.encode() for v in values])
    if kind == "binary":
        return lambda values: (1, [bytes(v) for v in values])
    raise ValueError(f"no feature for {kind}")


def _from_feature(kind: str):
    if kind == "boolean":
        return bool
    if kind in WHOLE:
        return int
    if kind in ("float", "double"):
        return lambda v: struct.unpack("<d", v)[0] if isinstance(v, bytes) else float(v)
    if kind == "string":
        return lambda v: v.decode()
    if kind == "binary":
        return bytes
    raise ValueError(f"no feature for {kind}")


def _shape(schema: StructType) -> dict[str, tuple[str, bool]]:
    """Per column: the type of a value, and whether it is a list of them."""
    out = {}
    for field in schema.fields:
        many = isinstance(field.dataType, ArrayType)
        out[field.name] = ((field.dataType.elementType if many else field.dataType).simpleString(), many)
    return out


def _stored(schema: StructType) -> str:
    """Times and dates travel as whole numbers: microseconds and days."""
    numbers = {"timestamp": "bigint", "timestamp_ntz": "bigint", "date": "int"}
    return ", ".join(f"`{n}` {f'array<{numbers.get(k, k)}>' if many else numbers.get(k, k)}" for n, (k, many) in _shape(schema).items())


def _as_numbers(df: DataFrame) -> DataFrame:
    out = {}
    for name, (kind, many) in _shape(df.schema).items():
        if kind in ("timestamp", "timestamp_ntz", "date"):
            number = (lambda c: F.unix_date(c)) if kind == "date" else (lambda c: F.unix_micros(c.cast("timestamp")))
            out[name] = F.transform(F.col(f"`{name}`"), number) if many else number(F.col(f"`{name}`"))
    return df.withColumns(out) if out else df


def _from_numbers(df: DataFrame, schema: StructType) -> DataFrame:
    columns = []
    for name, (kind, many) in _shape(schema).items():
        column = F.col(f"`{name}`")
        if kind in ("timestamp", "timestamp_ntz", "date"):
            back = (lambda c: F.date_from_unix_date(c)) if kind == "date" else (lambda c, k=kind: F.timestamp_micros(c).cast(k))
            column = F.transform(column, back) if many else back(column)
        columns.append(column.alias(name))
    return df.select(*columns)


class _Block(NamedTuple):
    """Records that lie side by side in a window of a file which starts ``at`` some place."""

    at: int
    data: np.ndarray
    begin: np.ndarray
    stop: np.ndarray
    good: np.ndarray  # whether the data fits its checksum

    def records(self) -> Iterator[tuple[int, bytes | None, str | None]]:
        for a, b, good in zip(self.begin.tolist(), self.stop.tolist(), self.good.tolist()):
            yield self.at + a - HEAD, self.data[a:b].tobytes() if good else None, None if good else "data does not fit its checksum"


class _Irregular(Exception):
    """Messages laid out otherwise than this module and the usual writers lay them out."""


def _need(sound: np.ndarray) -> None:
    if not sound.all():
        raise _Irregular


def _varints(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers at many places, and the places behind them."""
    value, at, going = np.zeros(len(at), np.uint64), at.copy(), np.arange(len(at))
    for shift in range(0, 70, 7):
        byte = data[np.minimum(at[going], len(data) - 1)]
        if shift == 63:
            _need(byte < 2)
        value[going] |= (byte & 127).astype(np.uint64) << np.uint64(shift)
        at[going] += 1
        going = going[byte > 127]
        if not len(going):
            break
    return value, at


def _within(data: np.ndarray, at: np.ndarray, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the messages of a tag at many places."""
    _need(data[np.minimum(at, len(data) - 1)] == tag)
    size, begin = _varints(data, at + 1)
    _need(size < len(data))
    return begin, begin + size.astype(np.int64)


def _gathered(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, one range after the other."""
    size = end - begin
    return data[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]


def _places(block: _Block, names: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Begin and end of each wanted feature in each record, begin -1 where it is missing.

    All records of the block are walked side by side, an entry of each at a step.
    """
    data, stop = block.data, block.stop
    keys = {n: np.frombuffer(n.encode(), np.uint8) for n in names}
    found = {n: (np.full(len(stop), -1, np.int64), np.full(len(stop), -1, np.int64)) for n in names}
    live = np.flatnonzero(block.begin < stop)
    at = block.begin.copy()
    at[live], end = _within(data, at[live], 10)
    _need(end == stop[live])
    live = live[at[live] < stop[live]]
    while len(live):
        entry, end = _within(data, at[live], 10)
        _need(end <= stop[live])
        key, key_end = _within(data, entry, 10)
        _need(key_end < end)
        value, value_end = _within(data, key_end, 18)
        _need(value_end == end)
        other = np.ones(len(live), bool)
        for name, letters in keys.items():
            same = np.flatnonzero(key_end - key == len(letters))
            same = same[(data[key[same][:, None] + np.arange(len(letters))] == letters).all(1)]
            found[name][0][live[same]], found[name][1][live[same]] = value[same], end[same]
            other[same] = False
        _need(_gathered(data, key[other], key_end[other]) < 128)  # names have to be text
        at[live] = end
        live = live[end < stop[live]]
    return found


def _columns(block: _Block, kinds: dict[str, str], types: dict[str, pa.DataType]) -> list[pa.Array]:
    """The features of all records of a block, one value each, as columns."""
    data, out = block.data, []
    for name, (begin, end) in _places(block, list(kinds)).items():
        kind, there = kinds[name], begin >= 0
        rows = np.flatnonzero(there)
        begin, end = begin[rows], end[rows]
        _need(begin < end)
        floats = kind in ("float", "double") and len(rows) > 0 and data[begin[0]] == 18
        inner, inner_end = _within(data, begin, 18 if floats else 26 if kind in WHOLE else 10)
        _need(inner_end == end)
        value, value_end = _within(data, inner, 10)
        _need(value_end == end)
        if kind in ("string", "binary"):
            size = np.zeros(len(there), np.int64)
            size[rows] = end - value
            bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            buffers = [pa.array(there).buffers()[1], pa.py_buffer(bounds), pa.py_buffer(_gathered(data, value, end))]
            column = pa.Array.from_buffers(pa.string() if kind == "string" else pa.binary(), len(there), buffers)
            try:
                column.validate(full=True)
            except pa.ArrowInvalid:
                raise _Irregular from None
            out.append(column.cast(types[name]))
            continue
        if kind in WHOLE:
            number, behind = _varints(data, value)
            _need(behind == end)
            number = number.view(np.int64)
            if kind == "boolean":
                number = number != 0
        else:
            width = 4 if floats else 8
            _need((end - value == width) & (floats or kind == "double"))
            number = data[value[:, None] + np.arange(width)].view(f"<f{width}")[:, 0]
        full = np.zeros(len(there), types[name].to_pandas_dtype())
        if number.dtype == np.int64 and full.dtype != np.int64:
            limits = np.iinfo(full.dtype)
            _need((number >= limits.min) & (number <= limits.max))
        full[rows] = number
        out.append(pa.array(full, types[name], mask=~there))
    return out


class _Chain:
    """The records of one file from a place on."""

    def __init__(self, path: str, size: int):
        self.files, self.path = store(path)
        self.file, self.size = self.files.open_input_file(self.path), size

    def bytes_at(self, start: int, count: int) -> np.ndarray:
        self.file.seek(start)
        return np.frombuffer(self.file.read(min(count, self.size - start)), np.uint8)

    def length_at(self, start: int) -> int | None:
        """The length in a header, if it fits its checksum."""
        head = self.bytes_at(start, HEAD)
        if len(head) < HEAD or int(masked_crc32c(head, [0], [8])[0]) != int(head[8:].view("<u4")[0]):
            return None
        return int(head[:8].view("<u8")[0])

    def starts(self, start: int) -> bool:
        """Whether a record starts here: its data, or else the header behind it, is sound too."""
        length = self.length_at(start)
        end = start + HEAD + (length or 0) + TAIL
        if length is None or end > self.size:
            return False
        if end == self.size or self.length_at(end) is not None:
            return True
        if length > LONGEST:
            return False
        data = self.bytes_at(start + HEAD, length + TAIL)
        return int(masked_crc32c(data, [0], [length])[0]) == int(data[length:].view("<u4")[0])

    def next_start(self, at: int, end: int) -> int:
        """The first place in [at, end) where a record starts, else ``end``."""
        window = SCAN
        while at < end:
            data = self.bytes_at(at, min(window, WINDOW, end - at + HEAD - 1))
            if len(data) < HEAD:
                return end
            many, window = len(data) - HEAD + 1, 2 * window
            # Only lengths that end inside the file are worth a checksum.
            length = sliding_window_view(data, 8)[:many].copy().view("<u8")[:, 0]
            room = self.size - at - HEAD - TAIL - np.arange(many)
            places = np.flatnonzero((room >= 0) & (length <= np.maximum(room, 0).astype(np.uint64)))
            told = data[places[:, None] + np.arange(8, 12)].view("<u4")[:, 0]
            for place in places[masked_crc32c(data, places, places + 8) == told].tolist():
                if at + place < end and self.starts(at + place):
                    return at + place
            at += many
        return end

    def records(self, start: int, end: int) -> Iterator[tuple[int, bytes | None, str | None]]:
        """(place, data, what is wrong) of the records that start in [start, end)."""
        for found in self.blocks(start, end):
            if isinstance(found, _Block):
                yield from found.records()
            else:
                yield found

    def blocks(self, start: int, end: int) -> Iterator[_Block | tuple[int, bytes | None, str | None]]:
        """As ``records``; those inside a window come as one block."""
        at = self.next_start(start, end) if start else 0
        known = at < end  # whether a record, sound or not, has to start at this place
        while at < end:
            data = self.bytes_at(at, WINDOW)
            places, lengths, read = [], [], 0
            while read + HEAD <= len(data) and at + read < end:
                length = struct.unpack_from("<Q", data, read)[0]
                places.append(read)
                lengths.append(length)
                if read + HEAD + length + TAIL > len(data):
                    break
                read += HEAD + length + TAIL
            if not places:
                yield at, None, "cut off in its header"
                return
            place = np.array(places)
            told = data[place[:, None] + np.arange(8, 12)].copy().view("<u4")[:, 0]
            head = masked_crc32c(data, place, place + 8) == told
            sound = len(places) if head.all() else int(np.argmin(head))
            inside = [k for k in range(sound) if places[k] + HEAD + lengths[k] + TAIL <= len(data)]
            begin = place[inside] + HEAD
            stop = begin + np.array([lengths[k] for k in inside], np.int64)
            if inside:
                told = data[stop[:, None] + np.arange(TAIL)].view("<u4")[:, 0]
                yield _Block(at, data, begin, stop, masked_crc32c(data, begin, stop) == told)
            if sound < len(places):
                # Where the next record starts is unknown: look for it.
                yield at + places[sound], None, "length does not fit its checksum"
                at = self.next_start(at + places[sound] + 1, end)
                known = at < end
                continue
            if len(inside) == sound:
                at += read
                continue
            # The last one is longer than the window.
            at, length = at + places[-1], lengths[-1]
            if at + HEAD + length + TAIL > self.size:
                yield at, None, "cut off by the end of the file"
                return
            if length > LONGEST:
                yield at, None, f"{length} bytes are more than a value can hold"
            else:
                data = self.bytes_at(at + HEAD, length + TAIL)
                good = int(data[length:].view("<u4")[0]) == int(masked_crc32c(data, [0], [length])[0])
                yield at, data[:length].tobytes() if good else None, None if good else "data does not fit its checksum"
            at += HEAD + length + TAIL
        if known and at < self.size and not self.starts(at):
            # The next range does not see that a record should start here.
            length = self.length_at(at)
            cut = at + HEAD > self.size or length is not None and at + HEAD + length + TAIL > self.size
            what = "length" if length is None else "data"
            yield at, None, "cut off by the end of the file" if cut else f"{what} does not fit its checksum"


def read_tfrecord(spark: SparkSession, path: str, schema: StructType, mode: str = "FAILFAST", split_bytes: int | None = SPLIT_BYTES) -> DataFrame:
    """The features named in ``schema`` of every record in the ``.tfrecord`` files below ``path``.

    Other features are passed over undecoded. A missing feature is null; of
    several values a column that is no list takes the first. A record that is
    damaged, or does not fit the schema, ends the query (``FAILFAST``) or is left
    out (``DROPMALFORMED``); with a string column ``_corrupt_record`` in the
    schema it comes as a row of nulls that says file, place and fault. Files
    whose records hold whole record files themselves need ``split_bytes=None``:
    a range in the middle of one would take the inner records for outer ones.
    """
    told = CORRUPT in schema.names
    own = StructType([f for f in schema.fields if f.name != CORRUPT])
    readers = {n: (_from_feature(k), many) for n, (k, many) in _shape(own).items()}
    stored = StructType.fromDDL(_stored(own)) if own.fields else own
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in stored.fields] + ([pa.field(CORRUPT, pa.string())] if told else []))

    def row(data: bytes) -> dict:
        features = decoded(data, set(readers))
        out = {}
        for name, (read, many) in readers.items():
            values = features.get(name)
            out[name] = None if values is None or (not many and not values) else [read(v) for v in values] if many else read(values[0])
        return out

    kinds = {n: k for n, (k, many) in _shape(own).items() if not many}
    types = {f.name: f.type for f in arrow}

    def columns(block: _Block) -> Iterator[pa.RecordBatch]:
        arrays = _columns(block, kinds, types) + ([pa.nulls(len(block.good), pa.string())] if told else [])
        made = pa.RecordBatch.from_arrays(arrays, schema=arrow)
        for low in range(0, len(made), 10_000):
            yield made.slice(low, 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for given in batch.to_pylist():
                for found in _Chain(given["path"], given["length"]).blocks(given["start"], given["end"]):
                    # Blocks with lists, damage or an unusual layout go record by record.
                    if isinstance(found, _Block) and readers and len(kinds) == len(readers) and found.good.all():
                        try:
                            yield from columns(found)
                            continue
                        except _Irregular:
                            pass
                    yield from single(given["path"], found.records() if isinstance(found, _Block) else [found])

    def single(path: str, records: Iterator[tuple[int, bytes | None, str | None]]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for place, data, fault in records:
            if fault is None:
                try:
                    rows.append(row(data))
                except (ValueError, TypeError, IndexError, struct.error) as error:
                    fault = f"not an example of this schema ({error})"
            if fault is not None and (told or mode == "FAILFAST"):
                text = f"{path} at {place}: {fault}"
                if not told:
                    raise ValueError(text)
                rows.append({CORRUPT: text})
            held += len(data or b"")
            if held > BATCH_BYTES or len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    ddl = _stored(own) + (f"{', ' if own.fields else ''}{CORRUPT} string" if told else "")
    out = file_ranges(spark, path, "*.tfrecord", split_bytes).mapInArrow(run, ddl)
    return _from_numbers(out, schema)


def _put(out: np.ndarray, at: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
    """Copies ranges of ``data`` to places of ``out``."""
    for a, b, n in zip(*(x[size > SHORT].tolist() for x in (at, begin, size))):
        out[a : a + n] = data[b : b + n]
    at, begin, size = (x[size <= SHORT] for x in (at, begin, size))
    step = np.arange(size.sum())
    ahead = np.cumsum(size) - size
    out[np.repeat(at - ahead, size) + step] = data[np.repeat(begin - ahead, size) + step]


def _value_bytes(kind: str, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begin, size) of a column's values, none null, as a feature holds them."""
    if kind in ("string", "binary"):
        values = values.cast(pa.large_binary())
        _, bounds, content = values.buffers()
        bounds = np.frombuffer(bounds, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
        return np.frombuffer(content or b"", np.uint8), bounds[:-1], np.diff(bounds)
    many = len(values)
    if kind in WHOLE:
        number = values.cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64)
        groups = number[:, None] >> np.arange(0, 70, 7, dtype=np.uint64)
        size = 1 + (groups[:, 1:] > 0).sum(1)
        data = (groups & np.uint64(127)).astype(np.uint8) | np.where(np.arange(10) < size[:, None] - 1, 128, 0).astype(np.uint8)
        return data.reshape(-1), np.arange(many) * 10, size
    width = 4 if kind == "float" else 8
    data = values.to_numpy(zero_copy_only=False).astype(f"<f{width}").view(np.uint8)
    return data, np.arange(many) * width, np.full(many, width)


def _lead_bytes(size: np.ndarray, lead) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begin, size) of what stands before so many bytes, for many sizes."""
    known, which = np.unique(size, return_inverse=True)
    leads = [lead(n) for n in known.tolist()]
    ends = np.cumsum([len(x) for x in leads], dtype=np.int64)
    lengths = np.diff(ends, prepend=0)
    return np.frombuffer(b"".join(leads), np.uint8), (ends - lengths)[which], lengths[which]


def _record_bytes(batch: pa.RecordBatch, kinds: dict[str, str]) -> np.ndarray:
    """The records of a batch without lists, with lengths and checksums; messages as ``encoded`` makes them."""
    body, parts = np.zeros(len(batch), np.int64), []
    for name, kind in kinds.items():
        column = batch.column(name)
        rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        value = _value_bytes(kind, column.drop_null())
        number = 3 if kind in WHOLE else 2 if kind == "float" else 1
        lead = _lead_bytes(value[2], lambda n: _entry_lead(name, number, len(_lead(1, n)) + n) + _lead(1, n))
        parts.append((rows, body[rows], lead, value))
        body[rows] += lead[2] + value[2]
    lead = _lead_bytes(body, lambda n: _lead(1, n))
    length = lead[2] + body
    stop = np.cumsum(length + HEAD + TAIL) - TAIL
    begin = stop - length
    out = np.empty(int(stop[-1]) + TAIL if len(stop) else 0, np.uint8)
    out[(begin - HEAD)[:, None] + np.arange(8)] = length.astype("<u8")[:, None].view(np.uint8)
    _put(out, begin, *lead)
    for rows, at, entry, value in parts:
        at = (begin + lead[2])[rows] + at
        _put(out, at, *entry)
        _put(out, at + entry[2], *value)
    for at, low, high in ((begin - TAIL, begin - HEAD, begin - TAIL), (stop, begin, stop)):
        out[at[:, None] + np.arange(TAIL)] = masked_crc32c(out, low, high).astype("<u4")[:, None].view(np.uint8)
    return out


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def write_tfrecord(df: DataFrame, path: str) -> DataFrame:
    """One ``.tfrecord`` file a task below ``path``; returns receipts (name, records, size_bytes).

    Whole numbers, booleans, dates (days) and times (microseconds) become number
    lists, floats float lists; doubles, which those would cut, are their eight
    bytes; nulls are left out. A file gets its name when it is whole and keeps
    it over retries of its task.
    """
    place = qualified(df.sparkSession, path)
    shape = _shape(df.schema)
    writers = {n: (_to_feature(k), many) for n, (k, many) in shape.items()}

    def records(batch: pa.RecordBatch) -> bytes:
        columns = {n: batch.column(n).to_pylist() for n in writers}
        bodies = []
        for k in range(len(batch)):
            features = {}
            for name, (write, many) in writers.items():
                value = columns[name][k]
                features[name] = None if value is None else write(value if many else [value])
            bodies.append(encoded(features))
        heads = b"".join(struct.pack("<Q", len(b)) for b in bodies)
        data = np.frombuffer(heads + b"".join(bodies), np.uint8)
        at = np.arange(len(bodies)) * 8
        ends = len(heads) + np.cumsum([len(b) for b in bodies])
        head_crc = masked_crc32c(data, at, at + 8).astype("<u4")
        body_crc = masked_crc32c(data, ends - [len(b) for b in bodies], ends).astype("<u4")
        return b"".join(heads[8 * k : 8 * k + 8] + head_crc[k].tobytes() + b + body_crc[k].tobytes() for k, b in enumerate(bodies))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        files, root = store(place)
        name = f"part-{TaskContext.get().partitionId():06d}.tfrecord"
        partial, count, size, out = f"{root}/_{name}.{uuid.uuid4().hex}", 0, 0, None
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(partial)
            step = max(1, len(batch) * WRITTEN // max(1, batch.nbytes))
            for low in range(0, len(batch), step):
                part = batch.slice(low, step)
                made = records(part) if any(many for _, many in shape.values()) else _record_bytes(part, {n: k for n, (k, _) in shape.items()})
                out.write(made)
                count, size = count + len(part), size + len(made)
        if out is not None:
            out.close()
            files.move(partial, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name], "records": [count], "size_bytes": [size]})

    receipts = _as_numbers(df).mapInArrow(run, "name string, records bigint, size_bytes bigint")
    receipts.write.mode("errorifexists").parquet(f"{path}/receipts")
    return df.sparkSession.read.schema(receipts.schema).parquet(f"{path}/receipts")
