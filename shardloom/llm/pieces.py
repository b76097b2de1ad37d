"""SentencePiece encoding and decoding by suffix-array matching.

A batch of texts is cut into units no piece can span (runs before each mark
that stands for a space), equal units are taken once, and their text is
concatenated. A suffix array of it, as deep as the longest piece, lets every
piece find all its places by binary search. The places are the edges (start,
end, piece) of a graph over positions; sorted by position they are relaxed:
in each unit the best-ranked edge that joins exactly two neighbouring symbols is
taken, the leftmost among equals, until none is left. That is the merge order of
the vocabulary, so ids equal those of the tokenizer library on any text.
Characters without a piece fall back to bytes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StructType

from shardloom.llm.common import read, small_batches, whole

MARK = "▁"
CHUNK_CHARS = 1_000_000
LONG_UNIT = 48
MEMO = 1_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary read from a model file: ranks, bytes and the piece matrix."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.vocab_size())
        self.byte_ids = np.full(256, -1, np.int32)
        self.raw: list[bytes] = []
        normal = []
        for i in ids:
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(text[3:5], 16)] = i
                self.raw.append(bytes([int(text[3:5], 16)]))
            elif model.is_control(i):
                self.raw.append(b"")
            elif model.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                self.raw.append(text.replace(MARK, " ").encode())
                normal.append((text, -model.get_score(i), i))
        normal.sort(key=lambda p: p[0])
        self.unknown = model.unk_id()
        self.texts = [p[0] for p in normal]
        scores = np.array([p[1] for p in normal])
        self.rank = np.unique(scores, return_inverse=True)[1].astype(np.int64)  # equal scores share a rank
        self.ids = np.array([p[2] for p in normal], np.int32)
        self.depth = max(map(len, self.texts))
        self.lengths = np.array([len(t) for t in self.texts])
        self.codes = np.zeros((len(normal), self.depth), np.int64)
        for row, t in zip(self.codes, self.texts):
            row[: len(t)] = [ord(c) + 1 for c in t]
        # Where a unit may end: before a mark after another character, if no piece spans that;
        # at a line end, if no piece holds one.
        marks_lead = not any(MARK in t.lstrip(MARK) for t in self.texts)
        lines_apart = not any("\n" in t for t in self.texts)
        end = "\n" if lines_apart else ""
        self.unit = re.compile(f"{MARK}+[^{MARK}{end}]*|[^{MARK}{end}]+|\n+") if marks_lead else re.compile(r"(?s).+")
        sizes = np.array([len(b) for b in self.raw], np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(sizes)])
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total) + shift


def suffix_array(codes: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next ``depth`` codes, none beyond ``left`` codes (to the unit's end)."""
    seen = np.zeros(int(codes.max()) + 1, np.int64)
    seen[codes] = 1
    small = np.cumsum(seen)[codes]  # codes by order, from 1
    n, bits = len(codes), int(seen.sum()).bit_length()
    step = max(1, min(depth, 62 // bits))
    key = np.zeros(n, np.int64)
    for k in range(step):  # the first codes fit one number
        key <<= bits
        rest = max(0, n - k)
        key[:rest] |= np.where(left[:rest] > k, small[k:], 0)
    while step < depth:
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        key = rank * (int(rank.max()) + 1)
        rest = max(0, n - step)
        key[:rest] += np.where(left[:rest] > step, rank[step:], 0)
        step *= 2
    return np.argsort(key)


def occurrences(pieces: Pieces, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, piece) of every place of every piece, sorted by start."""
    order = suffix_array(codes, left, pieces.depth)
    padded = np.concatenate([codes, np.zeros(pieces.depth, np.int64)])
    many = len(pieces.texts)

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(many, np.int64), np.full(many, len(order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            at = order[mid]
            sign = np.zeros(len(open_), np.int8)
            rest = np.arange(len(open_))  # pieces that agree so far
            for k in range(pieces.depth):
                own = pieces.codes[open_[rest], k]
                rest, own = rest[own != 0], own[own != 0]  # of the others all of the piece agrees
                if not rest.size:
                    break
                there = np.where(left[at[rest]] > k, padded[at[rest] + k], 0)
                sign[rest] = np.sign(there - own)
                rest = rest[there == own]
            right = (sign < 0) | (upper & (sign == 0))
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        return low

    first, last = bound(False), bound(True)
    piece = np.repeat(np.arange(many), last - first)
    start = order[ranges(first, last - first)]
    by_position = np.argsort(start)
    return start[by_position], piece[by_position]


def _relax_long(begin, end, edges, token, follow, alive):
    """One unit, edge by edge from a heap: the same order as the rounds."""
    before = {p: p - 1 for p in range(begin + 1, end)}
    heap = []
    for s in range(begin, end - 1):
        if (s, s + 2) in edges:
            heap.append((edges[s, s + 2][0], s, s + 2))
    heapq.heapify(heap)
    while heap:
        _, s, e = heapq.heappop(heap)
        if not alive[s] or follow[s] >= e or follow[follow[s]] != e:
            continue
        middle = follow[s]
        alive[middle] = False
        follow[s] = e
        token[s] = edges[s, e][1]
        if e < end:
            before[e] = s
            if (s, follow[e]) in edges:
                heapq.heappush(heap, (edges[s, follow[e]][0], s, follow[e]))
        if s > begin and (before[s], e) in edges:
            heapq.heappush(heap, (edges[before[s], e][0], before[s], e))


def encode_units(pieces: Pieces, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the ids of all units in a row, and where each unit's ids end."""
    sizes = np.array([len(u) for u in units], np.int64)
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    n = len(codes)
    ends = np.cumsum(sizes)
    unit = np.repeat(np.arange(len(units)), sizes)
    left = ends[unit] - np.arange(n)
    start, piece = occurrences(pieces, codes, left)
    length = pieces.lengths[piece]
    token = np.full(n, -1, np.int32)
    single = length == 1
    token[start[single]] = pieces.ids[piece[single]]
    start, piece, length = start[~single], piece[~single], length[~single]
    end, rank, ids = start + length, pieces.rank[piece], pieces.ids[piece]
    alive = np.ones(n + 1, bool)
    follow = np.minimum(np.arange(1, n + 3), n)

    for u in np.flatnonzero(sizes > LONG_UNIT):
        low, high = np.searchsorted(start, [ends[u] - sizes[u], ends[u]])
        edges = {(s, e): (r, i) for s, e, r, i in zip(start[low:high].tolist(), end[low:high].tolist(), rank[low:high].tolist(), ids[low:high].tolist())}
        _relax_long(int(ends[u] - sizes[u]), int(ends[u]), edges, token, follow, alive)
    short = sizes[unit[start]] <= LONG_UNIT
    start, end, rank, ids = start[short], end[short], rank[short], ids[short]
    while start.size:
        middle = follow[start]
        live = alive[start] & alive[end] & (middle < end)
        start, end, rank, ids, middle = start[live], end[live], rank[live], ids[live], middle[live]
        ready = np.flatnonzero(follow[middle] == end)
        if not ready.size:
            break
        key = rank[ready] * (n + 1) + start[ready]
        own = unit[start[ready]]
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        best = np.minimum.reduceat(key, heads)
        chosen = ready[key == np.repeat(best, np.diff(np.concatenate([heads, [len(own)]])))]
        alive[middle[chosen]] = False
        follow[start[chosen]] = end[chosen]
        token[start[chosen]] = ids[chosen]
        # Units whose edges all wait for others cannot move any more.
        moving = np.zeros(len(units), bool)
        moving[own] = True
        still = moving[unit[start]]
        start, end, rank, ids = start[still], end[still], rank[still], ids[still]

    at = np.flatnonzero(alive[:n])
    out, owner = token[at], unit[at]
    missing = np.flatnonzero(out < 0)
    if missing.size:
        chars = [chr(c - 1).encode("utf-8", "replace") for c in codes[at[missing]]]
        counts = np.ones(len(out), np.int64)
        counts[missing] = [len(c) for c in chars]
        wide = np.repeat(out, counts)
        owner = np.repeat(owner, counts)
        fallback = pieces.byte_ids[np.frombuffer(b"".join(chars), np.uint8)]
        wide[wide < 0] = np.where(fallback < 0, pieces.unknown, fallback)
        out = wide
    return out, np.cumsum(np.bincount(owner, minlength=len(units)))


class Encoder:
    """Encodes batches of texts; keeps the units it has met, up to a bound."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.reset()

    def reset(self):
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        self.used = 0

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): flat ids of all texts, and len(texts) + 1 offsets into them."""
        find = self.pieces.unit.findall
        units: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                own = find(MARK + text.replace(" ", MARK))
                counts[i] = len(own)
                units += own
        if not units:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        distinct = dict.fromkeys(units)
        if len(self.known) + len(distinct) > MEMO:
            self.reset()
        fresh = [u for u in distinct if u not in self.known]
        if fresh:
            ids, ends = encode_units(self.pieces, fresh)
            sizes = np.diff(np.concatenate([[0], ends]))
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            self.starts.append(ends - sizes + self.used)
            self.sizes.append(sizes)
            self.ids.append(ids)
            self.used += len(ids)
        slots = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        flat, starts, sizes = (np.concatenate(x) for x in (self.ids, self.starts, self.sizes))
        self.ids, self.starts, self.sizes = [flat], [starts], [sizes]
        of_unit = sizes[slots]
        tokens = flat[ranges(starts[slots], of_unit)]
        ends = np.concatenate([[0], np.cumsum(of_unit)])[np.concatenate([[0], np.cumsum(counts)])]
        return tokens, ends


def decode(pieces: Pieces, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of flat ids: piece bytes in a row, less the space put before each text."""
    sizes = pieces.raw_at[ids + 1] - pieces.raw_at[ids]
    data = pieces.raw_bytes[ranges(pieces.raw_at[ids], sizes)]
    at = np.concatenate([[0], np.cumsum(sizes)])[offsets]
    out = []
    for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
        text = data[low:high].tobytes().decode("utf-8", "replace")
        out.append(text[1:] if text.startswith(" ") else text)
    return out


def chunks(batch: pa.Array) -> Iterator[pa.Array]:
    """The texts of a batch in slices of at most CHUNK_CHARS characters; a longer text is a slice of its own.

    What the encoder holds beside its known units is many times a slice.
    """
    sizes = pc.fill_null(pc.utf8_length(batch), 0).to_numpy(zero_copy_only=False)
    low = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > CHUNK_CHARS:
            yield batch.slice(low, i - low)
            low, size = i, 0
        size += n
    if low < len(batch):
        yield batch.slice(low)


def encoded(pieces: Pieces, batches: Iterator[pa.Array], check: bool) -> Iterator[pa.Array]:
    """Structs (ids, round_trip) of all texts, in order; without ``check`` round_trip is true."""
    encoder = Encoder(pieces)
    for batch in batches:
        for part in chunks(batch):
            texts = part.to_pylist()
            ids, offsets = encoder(texts)
            same = [b == (t or "") for b, t in zip(decode(pieces, ids, offsets), texts)] if check else [True] * len(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], ["ids", "round_trip"])


def with_pieces(df: DataFrame, text: str = "text", model_file: str | None = None, check: bool = False) -> DataFrame:
    """``df`` and ``ids`` (array<int>); with ``check`` also ``round_trip``, whether decoding gives the text.

    Null and empty texts have no ids. A mark that a text holds itself decodes to
    a space, as the format has it; all else comes back. A column of the result's
    name that ``df`` has is replaced. Rows stay rows, repeated or not; texts of
    any length are encoded whole.
    """
    spark = df.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(Pieces(model_file or default_model()))
    kind = "ids array<int>, round_trip boolean"

    @arrow_udf(StructType.fromDDL(kind))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from encoded(sent.value, batches, check)

    told = df.select(whole(df).alias("doc"), run(F.col(text)).alias("told"))
    new = ["ids", "round_trip"] if check else ["ids"]
    return told.select(*[F.col(f"doc.`{c}`") for c in df.columns if c not in new], *[f"told.{c}" for c in new])


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_pieces(docs, check=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "round_trip", "ids")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids and the number of them."""
    return with_pieces(docs).withColumn("n_tokens", F.size("ids").cast("long"))
