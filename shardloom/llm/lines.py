"""Line dedup by a segment-partition edit join.

Lines are compared over their UTF-8 bytes. Two lines within ``edits`` edits share
one of ``edits + 1`` even segments of the shorter, hardly shifted. Each line
gives the hashes of its own segments (index) and, for each shorter length in
reach, of the few substrings that can match there (probes). Lines that meet at equal
hashes form groups, in which a banded bit-parallel edit distance verifies them.

A line is removed if an equal line, or one within ``edits`` edits, stands
earlier, by (doc_id, row, line number). The edit join leaves lines under
``min_bytes`` alone. ``equal_bytes`` is the floor for equal lines: the query and
the stage set none, so every line counts that has more than ASCII white space.
Only hashes are shuffled, packed per bucket; texts move for candidate lines alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import bits
from shardloom.llm.common import read, row_key, settle, small_batches, whole

EDITS = 2
BUCKET_BYTES = 32 << 20  # of text for each bucket of keys, which one task holds
MIN_BYTES = 24
CHUNK = 1_000_000
ROWS_AT_ONCE = 1_000_000
CELLS = 2_000_000
PART = 8192
TOGETHER = 40_000
ROW = "__row"


def cut_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, start, length) of all lines of some texts; a text has at least one line."""
    breaks = np.flatnonzero(data == 10)
    n = len(offsets) - 1
    per = 1 + np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1])
    row = np.repeat(np.arange(n), per)
    # A break that ends a text opens a line where the next text starts: order by row.
    own = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((np.concatenate([offsets[:-1], breaks + 1]), own))
    starts = np.concatenate([offsets[:-1], breaks + 1])[order]
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    number = np.arange(len(row)) - first[row]
    last = number == per[row] - 1
    following = np.append(starts[1:], 0)
    ends = np.where(last, offsets[row + 1], following - 1)
    return row, number, starts, ends - starts


def line_ids(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each line."""
    raw = data.tobytes()
    whole = [xxhash.xxh3_128_digest(raw[s : s + n]) for s, n in zip(start.tolist(), length.tolist())]
    both = np.frombuffer(b"".join(whole), "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def segment(length: np.ndarray, number: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment ``number`` (from 0) of lines of these lengths."""
    short = length // (edits + 1)
    long_from = (edits + 1) - length % (edits + 1)
    start = number * short + np.maximum(0, number - long_from)
    return start, short + (number >= long_from)


def _keys(edits: int, min_bytes: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bits.text_bytes(batch.column("text"))
            for low, high in bits.spans(offsets, CHUNK):
                part = data[offsets[low] : offsets[high]]
                _, _, start, length = cut_lines(part, offsets[low : high + 1] - offsets[low])
                long = length >= min_bytes
                start, length = start[long], length[long]
                line, _ = line_ids(part, start, length)
                line, first = np.unique(line, return_index=True)
                start, length = start[first], length[first]
                hashed = bits.Substrings(part)
                index, probe = [], []
                for i in range(edits + 1):
                    at, size = segment(length, i, edits)
                    index.append((hashed(start + at, size, i) ^ bits.mixed(length), line))
                    for less in range(edits + 1):
                        shorter = length - less
                        at, size = segment(shorter, i, edits)
                        for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                            fits = (at + shift >= 0) & (at + shift + size <= length) & (shorter >= min_bytes)
                            probe.append((hashed((start + at + shift)[fits], size[fits], i) ^ bits.mixed(shorter[fits]), line[fits]))
                rows = []
                for role, lists in ((0, index), (1, probe)):
                    key, own = (np.concatenate([x[k] for x in lists]) for k in (0, 1))
                    bucket, payload = bits.packed((key % np.uint64(buckets)).astype(np.int32), [key, own])
                    rows += [(b, role, p) for b, p in zip(bucket, payload)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                    ["bucket", "role", "payload"],
                )

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups (grp, line, role) of lines that meet at a key: 1 by their own segment, 2 by a probe, 3 by both.

    A group is named by its members, so that lines that meet at several keys do
    so once. Its size is the number of lines, never of pairs.
    """
    kept = []
    for batch in batches:
        for role, payload in zip(batch.column("role").to_pylist(), batch.column("payload")):
            key, line = bits.unpacked(payload.as_py(), ["<u8", "<i8"])
            kept.append((key, line, np.full(len(key), role + 1, np.uint8)))
    if not kept:
        return
    key, line, role = (np.concatenate(x) for x in zip(*kept))
    kept.clear()
    order = np.lexsort((line, key))
    key, line, role = key[order], line[order], role[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (line[1:] != line[:-1])])
    role = np.bitwise_or.reduceat(role, np.flatnonzero(new))
    key, line = key[new], line[new]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    many = np.diff(np.append(heads, len(key)))
    index = np.bitwise_or.reduceat(role, heads) == 3
    useful = np.repeat((many > 1) & index, many)
    name = np.add.reduceat(bits.mixed(line.view(np.uint64) * np.uint64(3) + role), heads)
    grp = bits.mixed(np.repeat(name, many)).view(np.int64)
    for low in range(0, len(grp), ROWS_AT_ONCE):
        own = useful[low : low + ROWS_AT_ONCE]
        columns = [x[low : low + ROWS_AT_ONCE][own] for x in (grp, line, role.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["grp", "line", "role"])


def not_blank(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each line has a byte other than ASCII white space."""
    seen = np.concatenate([[0], np.cumsum(~np.isin(data, np.frombuffer(b" \t\n\v\f\r", np.uint8)))])
    return seen[start + length] > seen[start]


def _places(min_bytes: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bits.text_bytes(batch.column("text"))
            row, number, start, length = cut_lines(data, offsets)
            long = np.flatnonzero((length >= min_bytes) | ((length >= least) & not_blank(data, start, length)))
            line, check = line_ids(data, start[long], length[long])
            take = pa.array(row[long])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column(ROW).take(take), pa.array(number[long].astype(np.int32)), pa.array(line), pa.array(check)],
                ["doc_id", ROW, "number", "line", "check"],
            )

    return run


def _texts(bitmap, min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bits.text_bytes(batch.column("text"))
            _, _, start, length = cut_lines(data, offsets)
            long = length >= min_bytes
            start, length = start[long], length[long]
            line, _ = line_ids(data, start, length)
            line, first = np.unique(line, return_index=True)
            hit = np.flatnonzero(bits.has_bit(bitmap.value, line))
            raw = data.tobytes()
            texts = [raw[s : s + n] for s, n in zip(start[first[hit]].tolist(), length[first[hit]].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(line[hit]), pa.array(texts, pa.binary())], ["line", "bytes"])

    return run


def within(a: list[bytes], b: list[bytes], edits: int) -> np.ndarray:
    """Whether each pair is at most ``edits`` edits apart: banded, bit-parallel over columns, side by side over pairs.

    The bits of a word are the rows around the diagonal; bit 63 is the row
    ``edits`` below it. The distance is followed down that diagonal to the last
    row, then along the last row.
    """
    m, n = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    near = np.abs(m - n) <= edits
    # What both begin and end with does not change their distance.
    longest = int(max(m.max(), n.max(), 1))
    x, y = (np.frombuffer(b"".join(t.ljust(longest, f) for t in side), np.uint8).reshape(-1, longest) for side, f in ((a, b"\0"), (b, b"\1")))
    unlike = x != y
    head = np.minimum(np.where(unlike.any(1), unlike.argmax(1), longest), np.minimum(m, n))
    x, y = (np.frombuffer(b"".join(t.rjust(longest, f) for t in side), np.uint8).reshape(-1, longest) for side, f in ((a, b"\0"), (b, b"\1")))
    unlike = x[:, ::-1] != y[:, ::-1]
    tail = np.minimum(np.where(unlike.any(1), unlike.argmax(1), longest), np.minimum(m, n) - head)
    a = [t[h : len(t) - e] for t, h, e in zip(a, head.tolist(), tail.tolist())]
    b = [t[h : len(t) - e] for t, h, e in zip(b, head.tolist(), tail.tolist())]
    m, n = m - head - tail, n - head - tail
    rows, columns = int(m.max()), int(n.max())
    pattern = np.full((len(a), rows + 2 * edits + columns + 2), 256, np.int16)  # row r stands at r + edits
    text = np.full((len(b), columns + 1), 257, np.int16)
    for i, (u, v) in enumerate(zip(a, b)):
        pattern[i, edits + 1 : edits + 1 + len(u)] = np.frombuffer(u, np.uint8)
        text[i, 1 : 1 + len(v)] = np.frombuffer(v, np.uint8)
    pattern, text = np.ascontiguousarray(pattern.T), np.ascontiguousarray(text.T)
    one = np.uint64(1)
    up = np.full(len(a), (2**64 - 1) << (63 - edits) & (2**64 - 1), np.uint64)
    down = np.zeros(len(a), np.uint64)
    distance = np.minimum(m, edits)
    out, own = np.zeros(len(a), bool), np.arange(len(a))
    for j in range(1, columns + 1):
        x = np.zeros(len(own), np.uint16)
        for d in range(2 * edits + 1):
            x = (x << np.uint16(1)) | (pattern[j + 2 * edits - d] == text[j])
        x = x.astype(np.uint64) << np.uint64(63 - 2 * edits)
        zero = (((x & up) + up) ^ up) | x | down
        plus, minus = down | ~(zero | up), zero & up
        along = j > m - edits  # the last row is reached
        if along.any():
            bit = np.clip(63 - (j + edits - m), 0, 63).astype(np.uint64)
            last = ((plus >> bit) & one).astype(np.int64) - ((minus >> bit) & one).astype(np.int64)
            step = np.where(along, last, 1 - (zero >> np.uint64(63)).astype(np.int64))
            distance += np.where(j <= n, step, 0)
        else:
            distance += 1 - (zero >> np.uint64(63)).astype(np.int64)
        up, down = minus | ~((zero >> one) | plus), (zero >> one) & plus
        if j % 16 == 0:
            # The cells of a column differ by 2 x edits at most: so far off, none leads back.
            going = (distance <= 3 * edits) & (j < n)
            if going.mean() < 0.8:
                ended = j >= n
                out[own[ended]] = near[own[ended]] & (distance[ended] <= edits)
                own, up, down, distance, m, n = (v[going] for v in (own, up, down, distance, m, n))
                pattern, text = pattern[:, going], text[:, going]
                if not len(own):
                    return out
    out[own] = near[own] & (distance <= edits)
    return out


def _late(edits: int):
    """Groups in order of first place: the lines that stand within ``edits`` of an earlier one they meet.

    All groups of a batch go on together: in round r each compares its r-th line
    with the later ones not yet found late, so a group of near copies ends soon.
    """

    def compare(texts: list[bytes], one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
        good = np.zeros(len(one), bool)
        order = np.argsort(size[two], kind="stable")
        cells = np.maximum(1, size[two][order])
        at = 0
        while at < len(order):
            # As many pairs as keep the padded texts small; lengths only grow along the order.
            to = max(at + 1, at + int(np.searchsorted(cells[at:] * np.arange(1, len(order) - at + 1), CELLS, "right")))
            own = order[at:to]
            good[own] = within([texts[i] for i in one[own].tolist()], [texts[i] for i in two[own].tolist()], edits)
            at = to
        return good

    def late(grp, role, side, line, texts):
        size = np.array([len(t) for t in texts], np.int64)
        start = np.concatenate([[True], grp[1:] != grp[:-1]])
        head = np.maximum.accumulate(np.where(start, np.arange(len(grp)), 0))
        open_ = np.flatnonzero(~start)
        found = np.zeros(len(grp), bool)
        step = 0
        while len(open_):
            pivot = head[open_] + step
            meets = ((role[pivot] & 1) & (role[open_] >> 1)) | ((role[pivot] >> 1) & (role[open_] & 1)) == 1
            meets &= (side[pivot] != side[open_]) | (side[open_] == 2)
            meets &= np.abs(size[pivot] - size[open_]) <= edits
            two = open_[meets]
            found[two] = compare(texts, pivot[meets], two, size)
            step += 1
            open_ = open_[~found[open_] & (open_ - head[open_] > step)]
        return np.unique(line[found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        rows = 0

        def emit(own):
            return pa.RecordBatch.from_arrays([pa.array(late(*own))], ["line"])

        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("grp", "role", "side", "line")] + [batch.column("bytes").to_pylist()])
            rows += batch.num_rows
            if rows >= TOGETHER:
                own = [np.concatenate([h[k] for h in held]) for k in range(4)] + [[t for h in held for t in h[4]]]
                # The last group may go on in the next batch.
                cut = int(np.flatnonzero(own[0] != own[0][-1])[-1]) + 1 if (own[0] != own[0][-1]).any() else 0
                held, rows = [[x[cut:] for x in own]], 0
                if cut:
                    yield emit([x[:cut] for x in own])
        own = [np.concatenate([h[k] for h in held]) for k in range(4)] + [[t for h in held for t in h[4]]] if held else None
        if own is not None and len(own[0]):
            yield emit(own)

    return run


def late_lines(docs: DataFrame, first: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(line): ids of the lines within ``edits`` edits of a different line that comes first earlier.

    ``first`` has (line, first). Groups above ``PART`` lines meet part by part.
    """
    spark = docs.sparkSession
    texts = docs.select("text")
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    keys = texts.mapInArrow(_keys(edits, min_bytes, buckets), "bucket int, role int, payload binary")
    groups = keys.repartition(buckets, "bucket").select("role", "payload").mapInArrow(_match, "grp long, line long, role int").distinct()
    groups = settle(groups, "line-groups")
    lines = groups.select("line").distinct()
    bitmap = spark.sparkContext.broadcast(bits.bit_map(lines, "line"))
    found = texts.mapInArrow(_texts(bitmap, min_bytes), "line long, bytes binary").groupBy("line").agg(F.first("bytes").alias("bytes"))
    told = found.join(first.groupBy("line").agg(F.min("first").alias("first")), "line")
    parts = groups.groupBy("grp").agg(F.ceil(F.count("*") / PART).alias("parts"))
    members = groups.join(parts, "grp").withColumn("own", F.pmod(F.xxhash64("line"), F.col("parts")))
    meet = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
        lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), F.when(F.col("own") < o, 0).when(F.col("own") > o, 1).otherwise(2).alias("side")),
    )
    members = members.select("grp", "line", "role", F.explode(meet).alias("p"))
    members = members.select(F.when((F.col("p.i") == 0) & (F.col("p.j") == 0), F.col("grp")).otherwise(F.xxhash64("grp", "p.i", "p.j")).alias("grp"), "line", "role", "p.side")
    met = members.join(told, "line").repartition("grp").sortWithinPartitions("grp", "first")
    return met.select("grp", "role", "side", "line", "bytes").mapInArrow(_late(edits), "line long").distinct()


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES, equal_bytes: int | None = None) -> DataFrame:
    """(doc_id, __row, removed): the line numbers (from 0) to take out of each document that has any.

    ``docs`` has doc_id, __row and text. Null texts have one empty line.
    Equal lines that are not blank go from ``equal_bytes`` bytes (by default ``min_bytes``).
    """
    least = min_bytes if equal_bytes is None else equal_bytes
    places = settle(docs.mapInArrow(_places(min_bytes, least), f"doc_id long, {ROW} long, number int, line long, check long"), "line-places")
    place = F.struct("doc_id", ROW, "number")
    first = settle(places.groupBy("line", "check").agg(F.min(place).alias("first")), "line-first")
    late = settle(late_lines(docs, first, edits, min_bytes), "line-late").withColumn("late", F.lit(True))
    known = first.join(late, "line", "left").select("line", "check", "first", F.coalesce("late", F.lit(False)).alias("late"))
    gone = places.join(known, ["line", "check"]).filter(F.col("late") | (place != F.col("first")))
    return gone.groupBy("doc_id", ROW).agg(F.array_sort(F.collect_set("number")).alias("removed"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES, equal_bytes: int | None = None) -> DataFrame:
    """(doc, text, removed): each row of ``docs`` as a struct, its text without repeated lines, their numbers or null.

    Rows equal in doc_id and text are one document and change alike. Null and
    empty texts, and documents without repeated lines, come back as they are.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(whole(docs).alias("doc"), "doc_id", "text", row_key().alias(ROW))
    gone = repeated_lines(keyed.select("doc_id", ROW, "text"), edits, min_bytes, equal_bytes)
    gone = settle(gone, "lines-gone").select(F.col("doc_id").alias("__id"), F.col(ROW).alias("__r"), "removed")
    joined = keyed.join(gone, (F.col(ROW) == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("removed", i))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select("doc", text.alias("text"), "removed")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many go and which, and a digest of the text that stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")), equal_bytes=1)
    return out.select(
        "doc.doc_id", "doc.n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated lines; one that has nothing left goes, as all of it stands elsewhere."""
    out = dedup_lines(docs, equal_bytes=1)
    out = out.filter(F.col("removed").isNull() | (F.trim("text") != ""))
    chars = F.when(F.col("removed").isNull(), F.col("doc.n_chars")).otherwise(F.length("text")) if "n_chars" in docs.columns else None
    new = {"text": F.col("text"), "n_chars": chars}
    return out.select(*[(new[c] if new.get(c) is not None else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
