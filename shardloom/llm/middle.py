"""Fill-in-the-middle: texts cut in three and put together in another order, and back.

Two cuts per text come from its key. A batch of texts is one array of bytes;
what moves is a piece between cuts, by one distance. The distances are written
at the starts of the pieces as differences, a cumulative sum spreads them over
all bytes, and one scatter puts every byte in its place; the marks fill the
gaps. Restoring finds the marks in the output, makes the same kind of distances
and gathers.

The marks contain no part of one another and texts that hold a mark stay as they
are, so reading back is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import bits
from shardloom.llm.common import read, small_batches

# The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
SEED = 1
PLAIN_FROM = 90  # of 100: texts that stay plain
SPM_BELOW = 20  # of 100: cut texts with the suffix first
CHUNK = 4_000_000
FORMS = np.array(["plain", "psm", "spm"])


def draws(key: str, seed: int = SEED) -> Column:
    """16 bytes that decide a row's cuts and form; a null key counts as an empty one."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.unhex(F.substring(F.sha2(told, 256), 1, 32))


def marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, letter, text) of every mark inside a text."""
    if len(data) < MARK:
        return (np.empty(0, np.int64),) * 3
    letter = data[1:-1]
    known = (letter == PREFIX[1]) | (letter == SUFFIX[1]) | (letter == MIDDLE[1])
    at = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2]) & known)
    doc = np.searchsorted(offsets, at, "right") - 1
    own = at + MARK <= offsets[doc + 1]
    return at[own], letter[at[own]], doc[own]


def spread(size: int, starts: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Every byte's distance from those of the pieces (in the order of the bytes) at their starts."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, np.diff(shifts, prepend=0))
    return np.cumsum(steps[:-1])


def cut(data: np.ndarray, offsets: np.ndarray, drawn: np.ndarray) -> dict[str, np.ndarray]:
    """Form and cuts of each text: sizes in code points, cuts as places in the bytes."""
    docs = len(offsets) - 1
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(heads, offsets)
    n = np.diff(first)
    one, two = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    place = np.append(heads, len(data))
    # The place after the last code point of a text is where the text ends.
    a, b = (np.where(k < n, place[np.minimum(first[:-1] + k, len(heads))], offsets[1:]) for k in (low, high))
    plain = (n == 0) | (drawn[:, 2] % 100 >= PLAIN_FROM)
    plain[marks(data, offsets)[2]] = True
    form = np.where(plain, 0, np.where(drawn[:, 3] % 100 < SPM_BELOW, 2, 1))
    return {"n": n, "form": form, "prefix": low, "middle": high - low, "a": a, "b": b, "docs": np.arange(docs)}


def scattered(data: np.ndarray, offsets: np.ndarray, told: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the outputs."""
    begin, end, form, a, b = offsets[:-1], offsets[1:], told["form"], told["a"], told["b"]
    size = np.diff(offsets) + np.where(form > 0, 3 * MARK, 0)
    out_offsets = np.concatenate([[0], np.cumsum(size)])
    at = out_offsets[:-1]
    prefix, middle, suffix = a - begin, b - a, end - b
    psm, spm = form == 1, form == 2
    # Where each piece starts in the output.
    to_prefix = at + np.where(psm, MARK, np.where(spm, 2 * MARK + suffix, 0))
    to_suffix = np.where(psm, at + 2 * MARK + prefix, at + MARK)
    to_middle = at + 3 * MARK + prefix + suffix
    to_suffix, to_middle = np.where(form > 0, to_suffix, at + prefix + middle), np.where(form > 0, to_middle, at + prefix)
    starts = np.stack([begin, a, b], 1).reshape(-1)
    shifts = np.stack([to_prefix - begin, to_middle - a, to_suffix - b], 1).reshape(-1)
    out = np.empty(int(out_offsets[-1]), np.uint8)
    out[np.arange(len(data)) + spread(len(data), starts, shifts)] = data
    moved = form > 0
    for mark, piece in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        for k in range(MARK):
            out[piece[moved] - MARK + k] = mark[k]
    return out, out_offsets


def gathered(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts behind outputs and forms."""
    begin, end = offsets[:-1], offsets[1:]
    place, letter, doc = marks(data, offsets)
    use = form[doc] > 0
    place, letter, doc = place[use], letter[use], doc[use]
    found = {}
    for mark in (PREFIX, SUFFIX, MIDDLE):
        found[mark] = begin.copy()
        own = letter == mark[1]
        found[mark][doc[own]] = place[own]
    p, s, m = found[PREFIX], found[SUFFIX], found[MIDDLE]
    cut_up, psm = form > 0, form == 1
    size = np.diff(offsets) - np.where(cut_up, 3 * MARK, 0)
    out_offsets = np.concatenate([[0], np.cumsum(size)])
    prefix = np.where(cut_up, np.where(psm, s, m) - p - MARK, end - begin)
    suffix = np.where(cut_up, np.where(psm, m, p) - s - MARK, 0)
    middle = np.where(cut_up, end - m - MARK, 0)
    at = out_offsets[:-1]
    starts = np.stack([at, at + prefix, at + prefix + middle], 1).reshape(-1)
    sources = np.stack([np.where(cut_up, p + MARK, begin), m + MARK, s + MARK], 1).reshape(-1)
    total = int(out_offsets[-1])
    return data[np.arange(total) + spread(total, starts, sources - starts)], out_offsets


def _column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    data, offsets = bits.text_bytes(batch.column(column))
    for low, high in bits.spans(offsets, CHUNK):
        yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in _pieces(batch, "text"):
            drawn = np.frombuffer(b"".join(part.column("drawn").to_pylist()), ">u4").reshape(-1, 4).astype(np.int64)
            told = cut(data, offsets, drawn)
            plain = told["form"] == 0
            columns = [part.column("key"), pa.array(told["n"].astype(np.int64)), pa.array(FORMS[told["form"]])]
            columns += [pa.array(told[k].astype(np.int64), mask=plain) for k in ("prefix", "middle")]
            columns.append(_column(*scattered(data, offsets, told)))
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "form", "prefix_chars", "middle_chars", "output"])


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = np.array(batch.column("form").fill_null("plain").to_pylist(), dtype=object)
        codes = np.where(names == "psm", 1, np.where(names == "spm", 2, 0))
        done = 0
        for part, data, offsets in _pieces(batch, "output"):
            form = codes[done : done + len(part)]
            done += len(part)
            yield pa.RecordBatch.from_arrays([*part.columns, _column(*gathered(data, offsets, form))], [*part.schema.names, "restored"])


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    ``n`` counts code points; the two cuts are null where the text stays plain.
    Null texts count as empty and empty ones stay plain, as do texts that hold a
    mark. Repeated rows give repeated, equal results; an empty table gives an
    empty one. Other columns are not read, whatever their names. A text of any
    length is cut as a whole; it has to fit into a task's memory a few dozen times.
    """
    small_batches(docs.sparkSession)
    given = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), draws(key, seed).alias("drawn"))
    kind = dict(docs.dtypes)[key]
    out = given.mapInArrow(_forward, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string")).withColumnRenamed("key", key)


def restore(made: DataFrame) -> DataFrame:
    """``made`` with the text that each (form, output) comes from, as ``restored``; other columns stay."""
    schema = ", ".join(f"`{c}` {'binary' if c == 'output' else kind}" for c, kind in made.dtypes)
    given = made.withColumn("output", F.coalesce("output", F.lit("")).cast("binary"))
    out = given.mapInArrow(_back, f"{schema}, restored binary")
    return out.withColumns({"output": F.col("output").cast("string"), "restored": F.col("restored").cast("string")})


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = restore(fill_in_middle(read(spark, sf_dir, "documents")))
    return both.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


OP11_SQL = """
WITH given AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM given
), told AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), cut AS (
  SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1, n - b) AS s FROM told
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""
