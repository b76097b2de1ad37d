"""Display text for sizes, counts and durations, in integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units by powers of 1024.
UNITS = ["B", "KB", "MB", "GB", "TB"]


def _whole(column: Column, by: int) -> Column:
    """Integer division of non-negative BIGINTs without a detour over DOUBLE."""
    return ((column - column % by) / by).cast("bigint")


def _tenths(value: Column, unit: int) -> Column:
    """Tenths of a unit, halves rounded up; whole units apart, so nothing overflows."""
    return _whole(value, unit) * 10 + _whole((value % unit) * 20 + unit, 2 * unit)


def format_bytes(size: Column) -> Column:
    """1536 -> "1.5 KB"; a zero decimal is left out."""
    text = None
    for power, unit in reversed(list(enumerate(UNITS))):
        tenths = _tenths(size, 1024**power)
        number = F.concat(
            _whole(tenths, 10).cast("string"),
            F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(""),
        )
        shown = F.concat(number, F.lit(f" {unit}"))
        text = F.when(size >= 1024**power, shown) if text is None else text.when(size >= 1024**power, shown)
    return text.when(size == 0, "0 B")


def format_number(number: Column) -> Column:
    """1500 -> "1.5K", 1500000 -> "1.5M"; smaller numbers stay as they are."""

    def short(unit: int, letter: str) -> Column:
        tenths = _tenths(number, unit)
        return F.concat(_whole(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(letter))

    return (
        F.when(number >= 1_000_000, short(1_000_000, "M"))
        .when(number >= 1000, short(1000, "K"))
        .otherwise(number.cast("string"))
    )


def _joined(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def format_duration(millis: Column) -> Column:
    """90000 -> "1m 30s"; hours show no seconds."""
    seconds = _whole(millis, 1000)
    minutes = _whole(seconds, 60)
    hours = _whole(minutes, 60)
    return (
        F.when(hours > 0, _joined(hours, "h ", minutes % 60, "m"))
        .when(minutes > 0, _joined(minutes, "m ", seconds % 60, "s"))
        .otherwise(_joined(seconds, "s"))
    )


def minutes_seconds(millis: Column) -> Column:
    """Whole minutes and seconds, also beyond an hour."""
    seconds = _whole(millis, 1000)
    return _joined(_whole(seconds, 60), "m ", seconds % 60, "s")


def relative_time(millis_ago: Column) -> Column:
    return (
        F.when(millis_ago < 1000, "just now")
        .when(millis_ago < 60_000, _joined(_whole(millis_ago, 1000), "s ago"))
        .when(millis_ago < 3_600_000, _joined(_whole(millis_ago, 60_000), "m ago"))
        .otherwise(_joined(_whole(millis_ago, 3_600_000), "h ago"))
    )
