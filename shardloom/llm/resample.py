"""Importance resampling of documents towards a target, by hashed n-grams.

Features are runs of one to three words, hashed into buckets by the CRC-32 of
their bytes. The CRC of two strings one after the other follows from the CRC of
each and a linear step for the length of the second, so a feature's CRC goes on
from the state of its first words. The vocabulary has a head and a tail: the
states of the most frequent words, and the states and buckets of the most
frequent pairs of them, are exact tables of bounded size that all tasks get;
words beyond the head have their CRC taken from their bytes. Both ways give the
same number, so totals and weights do not depend on where the head ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import bits
from shardloom.llm.common import read, settle, small_batches
from shardloom.llm.words import Words, words
from shardloom.operators.ordered import ordered

# Features, buckets, smoothing, seed and share of the draw.
LONGEST = 3
BUCKETS = 10_000
SEED = 42
MIN_WORDS = 20
SHARE = 5  # of 100
HEAD_WORDS = 32_768  # words with a ready state; about 1 MB
PAIR_WORDS = 1_024  # words whose pairs are counted
HEAD_PAIRS = 65_536  # pairs with a ready state and bucket; 1 MB
FLUSH = 500_000  # distinct words a task holds before it hands counts on
CHUNK = 2_000_000
ROW = "__row"


def _byte_steps() -> np.ndarray:
    """(256 lengths, 4, 256): what so many zero bytes make of each byte of a CRC-32 register."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    at = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = np.empty((256, 4, 256), np.uint32)
    for length in range(256):
        out[length] = at
        at = (at >> np.uint32(8)) ^ table[at & np.uint32(255)]
    return out


STEPS = _byte_steps()


def advanced(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What CRCs become when so many bytes follow, before those bytes' own CRC is added."""
    crc, length = crc.astype(np.uint32), length.astype(np.int64)
    while len(length) and length.max() > 0:
        step = np.minimum(length, 255)
        byte = np.uint32(255)
        crc = STEPS[step, 0, crc & byte] ^ STEPS[step, 1, (crc >> np.uint32(8)) & byte] ^ STEPS[step, 2, (crc >> np.uint32(16)) & byte] ^ STEPS[step, 3, crc >> np.uint32(24)]
        length = length - step
    return crc


def followed(crc: np.ndarray, own: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC of a string of CRC ``crc`` and, behind it, one of CRC ``own`` and this length."""
    return advanced(crc, length) ^ own


def word_states(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC, CRC with a space before, bytes with that space) of words, from their bytes."""
    space = zlib.crc32(b" ")
    crc = np.fromiter((zlib.crc32(w) for w in distinct), np.uint32, len(distinct))
    spaced = np.fromiter((zlib.crc32(w, space) for w in distinct), np.uint32, len(distinct))
    return crc, spaced, np.fromiter((len(w) + 1 for w in distinct), np.int64, len(distinct))


class Head:
    """The frequent words with their states, and the frequent pairs with theirs and their buckets."""

    def __init__(self, frequent: list[bytes], pairs: np.ndarray | None = None):
        self.words = pa.array(frequent, pa.large_binary())
        self.states = word_states(frequent)
        self.pairs = np.sort(pairs) if pairs is not None else np.empty(0, np.int64)
        crc, spaced, length = self.states
        left, right = self.pairs // PAIR_WORDS, self.pairs % PAIR_WORDS
        self.pair_crc = followed(crc[left], spaced[right], length[right])
        self.pair_bucket = (self.pair_crc % np.uint32(BUCKETS)).astype(np.int32)

    def numbers(self, distinct: pa.Array) -> np.ndarray:
        """Place of each word among the frequent ones, -1 for the tail."""
        return pc.index_in(distinct, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def features(self, found: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(texts, buckets) of all runs of one, two and three words of the texts."""
        place = self.numbers(found.distinct)
        tail = np.flatnonzero(place < 0)
        columns = [np.empty(len(place), a.dtype) for a in self.states]
        own = word_states(found.distinct.take(pa.array(tail)).to_pylist())
        for column, ready, direct in zip(columns, self.states, own):
            column[place >= 0] = ready[place[place >= 0]]
            column[tail] = direct
        crc, spaced, length = (c[found.code] for c in columns)
        yield found.doc, (crc % np.uint32(BUCKETS)).astype(np.int32)
        if len(crc) < 2:
            return
        number = place[found.code]
        two = found.doc[1:] == found.doc[:-1]
        left, right = np.flatnonzero(two), np.flatnonzero(two) + 1
        both = (number[left] >= 0) & (number[right] >= 0) & (number[left] < PAIR_WORDS) & (number[right] < PAIR_WORDS)
        key = np.where(both, number[left] * PAIR_WORDS + number[right], -1)
        at = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
        ready = both & (self.pairs[at] == key) if len(self.pairs) else np.zeros(len(key), bool)
        state, bucket = np.empty(len(left), np.uint32), np.empty(len(left), np.int32)
        state[ready], bucket[ready] = (self.pair_crc[at[ready]], self.pair_bucket[at[ready]]) if len(self.pairs) else ([], [])
        rest = ~ready
        state[rest] = followed(crc[left[rest]], spaced[right[rest]], length[right[rest]])
        bucket[rest] = (state[rest] % np.uint32(BUCKETS)).astype(np.int32)
        yield found.doc[left], bucket
        # A third word goes on from the pair's state.
        third = right + 1
        three = np.flatnonzero(third < len(found.doc))
        three = three[found.doc[third[three]] == found.doc[left[three]]]
        end = third[three]
        yield found.doc[end], (followed(state[three], spaced[end], length[end]) % np.uint32(BUCKETS)).astype(np.int32)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Words]]:
    data, offsets = bits.text_bytes(batch.column("text"))
    for low, high in bits.spans(offsets, CHUNK):
        yield batch.slice(low, high - low), words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for _, found in _parts(batch):
            many = np.bincount(found.code, minlength=len(found.distinct)).tolist()
            for w, n in zip(found.distinct.to_pylist(), many):
                held[w] = held.get(w, 0) + n
            if len(held) > FLUSH:
                yield told()
                held.clear()
    if held:
        yield told()


def _pair_counts(head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(PAIR_WORDS * PAIR_WORDS, np.int64)
        for batch in batches:
            for _, found in _parts(batch):
                number = head.value.numbers(found.distinct)[found.code]
                if len(number) > 1:
                    a, b = number[:-1], number[1:]
                    own = (found.doc[1:] == found.doc[:-1]) & (a >= 0) & (b >= 0) & (a < PAIR_WORDS) & (b < PAIR_WORDS)
                    pairs, many = np.unique(a[own] * PAIR_WORDS + b[own], return_counts=True)
                    counts[pairs] += many
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["pair", "n"])

    return run


def _bucket_counts(head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, found in _parts(batch):
                for _, bucket in head.value.features(found):
                    counts += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    return run


def _weights(head, gains):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in _parts(batch):
                docs = len(part)
                weight, many = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
                for doc, bucket in head.value.features(found):
                    # The texts come in order, so sums up to their ends give each text's sum.
                    sums = np.concatenate([[0], np.cumsum(gains.value[bucket])])
                    ends = np.searchsorted(doc, np.arange(docs + 1))
                    weight += np.diff(sums[ends])
                    many += np.diff(ends)
                columns = [part.column("key"), part.column(ROW), pa.array(found.counts(docs).astype(np.int64)), pa.array(many), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, ["key", ROW, "n_words", "n_features", "weight"])

    return run


def vocabulary(texts: DataFrame) -> Head:
    """The head of ``texts`` (text: binary): frequent words by exact counts, then frequent pairs of the first of them."""
    counts = texts.select("text").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequent = counts.orderBy(F.desc("n"), "word").limit(HEAD_WORDS).toArrow().column("word").to_pylist()
    if not frequent:
        return Head([])
    # A word of any length may be frequent; long ones take the direct way, so that the table stays small.
    frequent = [bytes(w) for w in frequent if len(w) <= 64]
    head = texts.sparkSession.sparkContext.broadcast(Head(frequent))
    pairs = texts.select("text").mapInArrow(_pair_counts(head), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    chosen = pairs.orderBy(F.desc("n"), "pair").limit(HEAD_PAIRS).toArrow().column("pair").to_numpy()
    return Head(frequent, chosen.astype(np.int64))


def bucket_totals(texts: DataFrame, head) -> np.ndarray:
    """Features per bucket over all ``texts``; at most ``BUCKETS`` rows reach the driver."""
    rows = texts.select("text").mapInArrow(_bucket_counts(head), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares per bucket, rounded down."""
    s, t = raw.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) for every row of ``docs``.

    ``rank`` counts from 1 along falling scores, ties by key (null first) and
    then text, over the drawn ``share`` of 100 of the documents of at least
    ``min_words`` words; it is null for all others. Null and empty texts have no
    features and weight 0; a null key is drawn for as an empty one. Rows equal
    in key and text get neighbouring ranks. Without target texts every
    bucket's target count is 0; without documents the result is empty. Further
    columns on either side are not read. Texts are counted whole.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def given(df: DataFrame, *more) -> DataFrame:
        return df.select(*more, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    head = spark.sparkContext.broadcast(vocabulary(given(docs)))
    gains = bucket_gains(bucket_totals(given(docs), head), bucket_totals(given(target), head))
    kind = dict(docs.dtypes)[key]
    keyed = given(docs, F.col(key).alias("key"), F.xxhash64(F.col(text)).alias(ROW))
    weighed = keyed.mapInArrow(_weights(head, spark.sparkContext.broadcast(gains)), f"key {kind}, {ROW} long, n_words long, n_features long, weight long")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weighed.withColumn("score", F.col("weight") + noise)
    out = settle(scored.withColumns({"__out": F.col("n_words") < min_words, "__fall": -F.col("score"), "__copy": F.monotonically_increasing_id()}), "scores")
    take = out.filter(~F.col("__out")).count() * share // 100
    placed = ordered(out, [], ["__out", "__fall", "key", ROW, "__copy"], position="__at")
    rank = F.when(~F.col("__out") & (F.col("__at") < take), F.col("__at") + 1)
    return placed.select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
