"""Little-endian fields in BINARY columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _swapped(digits: Column, width: int) -> Column:
    pairs = [F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))]
    return F.concat(*pairs)


def little_endian(value: Column, width: int) -> Column:
    """A non-negative integer as ``width`` bytes, lowest byte first."""
    return F.unhex(_swapped(F.lpad(F.hex(value.cast("bigint")), 2 * width, "0"), width))


def read_little_endian(content: Column, start: int, width: int) -> Column:
    """The integer in ``width`` bytes from the 0-based ``start``; null if cut off.

    Values of 2**63 and above do not fit BIGINT and give null as well.
    """
    raw = F.substring(content, start + 1, width)
    number = F.conv(_swapped(F.hex(raw), width), 16, 10).try_cast("bigint")
    return F.when(F.octet_length(raw) == width, number)
