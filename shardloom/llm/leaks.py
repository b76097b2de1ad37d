"""Benchmark decontamination: test items found in documents by one Aho-Corasick automaton.

Items and documents are the same kind of words. A window is ten consecutive
words of an item, or all of them where it has fewer. All windows go into one
automaton over word numbers; the words of a document stream through it once,
stretches without words of the benchmark left out. Lower case changes no byte's
place, so a word that is hit is known by its range in the original text.

The windows reach the tasks by a broadcast of at most ``PATTERNS`` windows; a
larger benchmark is dealt into several automata, which the documents pass one
after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import bits
from shardloom.llm.common import read, settle, small_batches
from shardloom.llm.words import PATTERN, UPPER, words

WINDOW = 10
PATTERNS = 200_000  # windows of one automaton: some 100 MB in a task
CHUNK = 4_000_000
SCHEMA = "key {kind}, text binary, n_words long, hits binary, items array<string>"

_built: dict[str, tuple] = {}  # the automaton of this Python worker


def windows(items: DataFrame, key: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(window, items): each distinct window with the ids, as strings, of the items that hold it.

    Null texts and texts without words have no window; a null id counts as an empty string.
    """
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower())
    told = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(lowered, F.lit(PATTERN), F.lit(0)).alias("w")).filter("size(w) > 0")
    last = F.greatest(F.size("w") - width, F.lit(0))
    starts = told.select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    cut = starts.select("item", F.array_join(F.slice("w", F.col("at") + 1, width), " ").alias("window"))
    return cut.groupBy("window").agg(F.collect_set("item").alias("items"))


class Automaton:
    """Windows over word numbers (from 1); word 0 is any word that no window holds."""

    def __init__(self, patterns: list[str], items: list[list[str]]):
        split = [p.split(" ") for p in patterns]
        distinct = sorted({w for p in split for w in p})
        number = {w: k for k, w in enumerate(distinct, 1)}
        self.vocabulary = pa.array([w.encode() for w in distinct], pa.large_binary())
        self.items, self.size = items, np.array([len(p) for p in split], np.int64)
        self.shortest = int(self.size.min())
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, p in enumerate(split):
            self.tree.add_word(tuple(number[w] for w in p), k)
        self.tree.make_automaton()

    def numbers(self, distinct: pa.Array) -> np.ndarray:
        found = pc.index_in(distinct, value_set=self.vocabulary)
        return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    def matches(self, number: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, window) of every occurrence; ``number`` and ``doc`` are given per word."""
        # A stretch of known words shorter than the shortest window is passed over.
        known = number > 0
        heads = np.flatnonzero(known & np.concatenate([[True], ~known[:-1] | (doc[1:] != doc[:-1])])) if len(known) else np.empty(0, int)
        tails = np.flatnonzero(known & np.concatenate([~known[1:] | (doc[1:] != doc[:-1]), [True]])) if len(known) else np.empty(0, int)
        long = tails - heads + 1 >= self.shortest
        heads, tails = heads[long], tails[long]
        if not len(heads):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        # The stretches one after the other, a 0 behind each.
        size = tails - heads + 2
        begin = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(begin[-1]) - np.repeat(begin[:-1], size) + np.repeat(heads, size)
        sequence = number[np.minimum(place, len(number) - 1)]
        sequence[begin[1:] - 1] = 0
        found = list(self.tree.iter(tuple(sequence.tolist())))
        at = np.array(found, np.int64).reshape(-1, 2)
        return place[at[:, 0]], at[:, 1]


def _scan(name: str, broadcast, first: bool):
    def automaton() -> Automaton:
        if name not in _built:
            _built.clear()
            _built[name] = Automaton(*broadcast.value)
        return _built[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bits.text_bytes(batch.column("text"))
            for low, high in bits.spans(offsets, CHUNK):
                part = batch.slice(low, high - low)
                yield scan(part, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])

    def scan(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        docs, auto = len(part), automaton()
        found = words(data, offsets)
        many = found.counts(docs)
        at, window = auto.matches(auto.numbers(found.distinct)[found.code], found.doc)
        steps = np.zeros(len(found.start) + 1, np.int64)
        np.add.at(steps, at + 1 - auto.size[window], 1)
        np.add.at(steps, at + 1, -1)
        hit = np.cumsum(steps[:-1]) > 0
        begin = np.concatenate([[0], np.cumsum(many)])
        held = np.unique(np.stack([found.doc[at], window], 1), axis=0) if len(at) else np.empty((0, 2), np.int64)
        own_windows = np.split(held[:, 1], np.searchsorted(held[:, 0], np.arange(1, docs)))
        some = np.unique(held[:, 0])
        hits, items = [b""] * docs, [[]] * docs
        for d in some.tolist():
            hits[d] = hit[begin[d] : begin[d + 1]].astype(np.uint8).tobytes()
            items[d] = sorted({i for w in own_windows[d].tolist() for i in auto.items[w]})
        if not first:
            for d, (flags, names) in enumerate(zip(part.column("hits").to_pylist(), part.column("items").to_pylist())):
                if names:
                    items[d] = sorted({*names, *items[d]})
                    before = np.frombuffer(flags, np.uint8)
                    hits[d] = (before | np.frombuffer(hits[d], np.uint8)).tobytes() if hits[d] else flags
        columns = [part.column("key"), part.column("text"), pa.array(many.astype(np.int64)), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["key", "text", "n_words", "hits", "items"])

    return run


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hit words to ranges of code points in the text."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        n_hit, spans = [], []
        for text, flags in zip(batch.column("text"), batch.column("hits").to_pylist()):
            hit = np.frombuffer(flags, np.uint8).astype(bool)
            n_hit.append(int(hit.sum()))
            if not hit.any():
                spans.append([])
                continue
            data, offsets = bits.text_bytes(pa.array([text.as_py()], pa.binary()))
            found = words(data, offsets)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            heads = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1]]))
            tails = np.flatnonzero(hit & np.concatenate([~hit[1:], [True]]))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(points[found.start[heads]], points[found.end[tails]])])
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_words"), pa.array(n_hit, pa.int64()), batch.column("items"), pa.array(spans, kind)], ["key", "n_words", "n_hit", "items", "spans"])


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW, patterns: int = PATTERNS) -> DataFrame:
    """(key, n_words, n_hit, items, spans) for every row of ``docs``.

    ``n_hit`` counts words inside occurrences of a window of ``items`` (item_id,
    text), ``items`` are the ids with occurring windows as sorted strings, and
    ``spans`` the maximal runs of hit words as ranges of code points in the
    text. Null and empty texts have no words; repeated rows give repeated, equal
    results; without documents or items nothing is hit. Items of equal text are
    all named. Further columns on either side are not read. Texts of any length
    are scanned whole, one row in a task's memory at a time with what is smaller.
    """
    spark = docs.sparkSession
    small_batches(spark)
    told = settle(windows(items, width=width), "windows")
    blocks = max(1, -(-told.count() // patterns))
    kind = dict(docs.dtypes)[key]
    at = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    for block in range(blocks):
        # At most about ``patterns`` windows; the automaton is built once in each Python worker.
        own = told.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).toArrow().to_pydict()
        if not own["window"]:
            if block == 0:
                at = at.mapInArrow(_wordless, SCHEMA.format(kind=kind))
            continue
        name = hashlib.sha256(repr(own["window"]).encode()).hexdigest()
        scan = _scan(name, spark.sparkContext.broadcast((own["window"], own["items"])), block == 0)
        at = at.mapInArrow(scan, SCHEMA.format(kind=kind))
        if block + 1 < blocks:
            at = settle(at, "scanned")
    spans = "array<struct<start:long,end:long>>"
    out = at.mapInArrow(_report, f"key {kind}, n_words long, n_hit long, items array<string>, spans {spans}")
    return out.withColumnRenamed("key", key)


def _wordless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that no window is looked for in."""
    for batch in batches:
        data, offsets = bits.text_bytes(batch.column("text"))
        many = words(data, offsets).counts(len(batch))
        columns = [*batch.columns, pa.array(many.astype(np.int64)), pa.array([b""] * len(batch), pa.binary()), pa.array([[]] * len(batch), pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "text", "n_words", "hits", "items"])


def op13_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP13_SQL = rf"""
WITH items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{PATTERN}') AS w FROM benchmark
), patterns AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[p + 1:p + {WINDOW}], ' ') AS window_text
  FROM (SELECT item, w, unnest(range(greatest(len(w) - {WINDOW}, 0) + 1)) AS p FROM items WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{PATTERN}') AS w FROM documents
), places AS (
  SELECT r, n, p, array_to_string(w[p + 1:p + n], ' ') AS window_text
  FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS p FROM docs, (SELECT DISTINCT n FROM patterns) WHERE len(w) >= n)
), found AS (SELECT r, p, places.n, item FROM places JOIN patterns USING (n, window_text)
), hits AS (
  SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS word FROM (SELECT DISTINCT r, p, n FROM found)) GROUP BY r
), named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""
