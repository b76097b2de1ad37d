"""Input checks: each gives the first failed rule, or null when all hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits in bytes and entries, accepted patterns, white space that
# is trimmed, and the length (in characters) of cleaned text.
MAX_WORKER_ID = 128
MAX_DATASET_ID = 256
MAX_PATH = 4096
MAX_ENTRIES = 64
MAX_KEY = 128
MAX_VALUE = 1024
MAX_PORT = 65535
ID_PATTERN = r"^[a-zA-Z0-9_\-\.]+\z"
HOST_PORT_PATTERN = r"^[A-Za-z0-9_.\-]+:[0-9]{1,5}\z"
SCHEME_PATTERN = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
HTTP_PATTERN = r"^(?i)https?:[/\\]*[^/\\?#\s]"
BLANKS = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CLEAN_LENGTH = 1000


def id_reason(value: Column, max_bytes: int) -> Column:
    return (
        F.when(F.coalesce(F.octet_length(value), F.lit(0)) == 0, "empty")
        .when(F.octet_length(value) > max_bytes, "too_long")
        .when(~value.rlike(ID_PATTERN), "invalid_characters")
    )


def path_reason(value: Column) -> Column:
    return (
        F.when(F.octet_length(value) > MAX_PATH, "too_long")
        .when(F.contains(value, F.lit("..")), "path_traversal")
        .when(F.contains(value, F.lit("\0")), "null_byte")
    )


def metadata_reason(entries: Column, max_entries: int = MAX_ENTRIES, max_key: int = MAX_KEY, max_value: int = MAX_VALUE) -> Column:
    return (
        F.when(F.size(entries) > max_entries, "too_many_entries")
        .when(F.exists(F.map_keys(entries), lambda k: F.octet_length(k) > max_key), "key_too_long")
        .when(F.exists(F.map_values(entries), lambda v: F.octet_length(v) > max_value), "value_too_long")
    )


def number_reason(value: Column) -> Column:
    return F.when(value < 0, "negative")


def port_reason(value: Column) -> Column:
    return F.when(~value.between(1, MAX_PORT), "port_out_of_range")


def cleaned(text: Column) -> Column:
    """Drop angle brackets and script schemes and trim: the whole text."""
    return trimmed(without_scheme(without_brackets(text)))


def sanitized(text: Column, length: int = CLEAN_LENGTH) -> Column:
    """The first ``length`` characters of a cleaned text, for display."""
    return F.substring(cleaned(text), 1, length)


def without_brackets(text: Column) -> Column:
    return F.translate(text, "<>", "")


def without_scheme(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)javascript:", "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+\\z", "")


def endpoint_valid(url: Column) -> Column:
    """An http(s) URL, or host:port that is not itself read as a URL scheme.

    A pattern check of the service's rule, not a full URL parser.
    """
    bare = url.rlike(HOST_PORT_PATTERN) & ~url.rlike(SCHEME_PATTERN)
    return url.rlike(HTTP_PATTERN) | bare
