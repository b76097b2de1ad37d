"""Array helpers: text batches as bytes, substring hashes, packed shuffles, bounded bit maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Any fixed odd numbers do; they only have to agree between tasks.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xD6E8FEB86659FD93)
MAP_BITS = 25
U64 = np.uint64


def odd_inverse(x: int) -> int:
    """The inverse of an odd number modulo 2**64."""
    y = x
    for _ in range(6):
        y = y * (2 - x * y) % 2**64
    return y


UNBASE = U64(odd_inverse(int(BASE)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= MIX
    x ^= x >> U64(32)
    x *= MIX
    x ^= x >> U64(32)
    return x


def byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)


class Substrings:
    """Hashes of any substrings of one byte array, in constant time each."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data)
        power = np.full(n + 1, BASE, U64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(byte_table(seed)[data] * power[:n], out=self.sums[1:])
        back = np.full(n + 1, UNBASE, U64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)

    def __call__(self, start: np.ndarray, length: np.ndarray, salt=0) -> np.ndarray:
        raw = (self.sums[start + length] - self.sums[start]) * self.back[start]
        return mixed(raw + np.asarray(length).astype(U64) * MIX + U64(salt * int(BASE) % 2**64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a longer row is a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def packed(bucket: np.ndarray, columns: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """One row per bucket: its entries as the bytes of one array after the other."""
    order = np.argsort(bucket, kind="stable")
    own = bucket[order]
    heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, int)
    ends = np.append(heads[1:], len(own))
    sorted_columns = [c[order] for c in columns]
    return own[heads].tolist(), [b"".join(c[a:b].tobytes() for c in sorted_columns) for a, b in zip(heads, ends)]


def unpacked(payload: bytes, kinds: list[str]) -> list[np.ndarray]:
    """The arrays of one packed row."""
    sizes = [np.dtype(k).itemsize for k in kinds]
    n = len(payload) // sum(sizes)
    out, at = [], 0
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(payload, kind, n, at))
        at += n * size
    return out


def bit_map(keys: DataFrame, column: str, bits: int = MAP_BITS) -> np.ndarray:
    """A map of ``2**bits`` bits with the bit of every key set, whatever the number of keys.

    For sparing work only: a key whose bit is clear is surely absent, and what
    passes is joined exactly later. Its size is fixed, so it may be broadcast.
    """
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    word = F.shiftright(place, 15)
    rows = keys.groupBy(word.alias("word")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros((1 << max(0, bits - 15), 4096), np.uint8)
    for r in rows:
        out[r.word] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def has_bit(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bits of these int64 or uint64 keys are set."""
    place = keys.astype(U64) & U64(len(bitmap) * 8 - 1)
    return (bitmap[place >> U64(3)] >> (place & U64(7)).astype(np.uint8)) & 1 == 1
