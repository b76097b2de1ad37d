"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Terms are whole words and word beginnings (languages that inflect share them).
The terms that speak for a toxic label (its share among their documents is a
multiple of the usual one, and chi squared is large) are chosen on labelled rows; document frequencies come from all documents. Labelled examples with
equal term vectors are one entry of an inverted index whose entries lie in
blocks; each term knows its largest weight per block. A query adds these up to a
bound per block, visits blocks from the highest bound and stops when no bound
can beat its k-th cosine, so its neighbours are exact. Their labels vote, near
ones more, and votes are mapped to rates seen when examples leave themselves out.

Only the classifier is bounded (``MAX_EXAMPLES`` labelled rows drawn by a hash,
``MAX_TERMS`` terms), so it can be broadcast; every document is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import read, whole

MAX_EXAMPLES = 20_000
MAX_TERMS = 2048
MIN_COUNT = 5
MIN_CHI2 = 15.0
PREFIXES = (3, 4, 5, 6)
NEIGHBOURS = 8
BLOCK = 128
MIN_LIFT = 3.0
THRESHOLD = 0.3
MEMO = 400_000
WORDS = re.compile(r"\w+")


def terms_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def word_counts(text) -> Counter:
    return Counter(WORDS.findall(text.lower())) if isinstance(text, str) else Counter()


class TermFinder:
    """Chosen terms of a text with their counts; remembers what each word gives."""

    def __init__(self, terms: dict[str, int]):
        self.terms, self.memo = terms, {}

    def __call__(self, text) -> tuple:
        found: dict[int, int] = {}
        memo = self.memo
        for word, n in word_counts(text).items():
            hits = memo.get(word)
            if hits is None:
                if len(memo) > MEMO:
                    memo.clear()
                hits = memo[word] = tuple(self.terms[t] for t in terms_of(word) if t in self.terms)
            for t in hits:
                found[t] = found.get(t, 0) + n
        return tuple(sorted(found.items()))


class Index:
    """Block-max inverted index over the distinct vectors of the examples."""

    def __init__(self, idf: np.ndarray, vectors: list[tuple], n: list[int], toxic: list[int], first: list[int]):
        order = sorted(range(len(vectors)), key=lambda i: vectors[i])
        self.idf = idf
        self.n = np.array([n[i] for i in order], float)
        self.toxic = np.array([toxic[i] for i in order], float)
        self.first = [first[i] for i in order]
        self.blocks = -(-len(order) // BLOCK)
        self.entry = {vectors[i]: at for at, i in enumerate(order)}
        self.base = (self.toxic.sum() + 0.5) / (self.n.sum() + 1.0) if order else 0.0
        lists: dict[int, dict[int, list]] = {}
        for at, i in enumerate(order):
            for t, w in zip(*self.weights(vectors[i])):
                lists.setdefault(t, {}).setdefault(at // BLOCK, []).append((at, w))
        # term -> (block numbers, largest weight in each); (term, block) -> (entries, weights)
        self.tops = {t: (np.array(list(b)), np.array([max(w for _, w in p) for p in b.values()])) for t, b in lists.items()}
        self.postings = {
            (t, b): (np.array([a for a, _ in p]), np.array([w for _, w in p])) for t, bs in lists.items() for b, p in bs.items()
        }

    def weights(self, vector: tuple) -> tuple[list[int], np.ndarray]:
        ids = [t for t, _ in vector]
        w = np.array([1.0 + math.log(c) for _, c in vector]) * self.idf[ids]
        return ids, w / np.sqrt((w * w).sum())

    def nearest(self, vector: tuple, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Entries and cosines of the k nearest, exact; ties to the earlier entry."""
        ids, w = self.weights(vector)
        bound = np.zeros(self.blocks)
        for t, x in zip(ids, w):
            if t in self.tops:
                blocks, top = self.tops[t]
                bound[blocks] += x * top
        found, scores = np.empty(0, int), np.empty(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(scores) >= k and bound[b] < scores[k - 1] - 1e-12):
                break
            low = b * BLOCK
            here = np.zeros(min(BLOCK, len(self.n) - low))
            for t, x in zip(ids, w):
                hit = self.postings.get((t, b))
                if hit is not None:
                    here[hit[0] - low] += x * hit[1]
            own = np.flatnonzero(here > 0)
            found, scores = np.concatenate([found, own + low]), np.concatenate([scores, here[own]])
            best = np.lexsort((found, -scores))[:k]
            found, scores = found[best], scores[best]
        return found, np.minimum(scores, 1.0)

    def vote(self, vector: tuple, leave: int | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """Weighted share of toxic examples; ``leave``: the label of one example to leave out."""
        found, cosines = self.nearest(vector)
        weight = 1.0 / (0.05 + 1.0 - cosines)
        n, toxic = self.n[found], self.toxic[found]
        if leave is not None:
            own = found == self.entry[vector]
            n, toxic = n - own, toxic - own * leave
        return float(((weight * toxic).sum() + self.base) / ((weight * n).sum() + 1.0)), found, cosines


def held_out(key: Column) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2


class Model:
    """What the tasks need: terms, index, calibration and the rate of texts without terms."""

    def __init__(self, terms: dict[str, int], index: Index, knots: list[tuple[float, float]], empty: float):
        self.terms, self.index, self.knots, self.empty = terms, index, knots, empty

    def calibrated(self, raw: float) -> float:
        if not self.knots:
            return raw
        x, y = zip(*self.knots)
        return float(np.interp(raw, x, y))


def _partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents per term and label, one row per term and task."""
    counts: dict[str, list[int]] = {}
    for rows in batches:
        for text, toxic in zip(rows["text"], rows["toxic"]):
            for term in {t for word in word_counts(text) for t in terms_of(word)}:
                counts.setdefault(term, [0, 0])[toxic] += 1
    yield pd.DataFrame([(t, b, a) for t, (a, b) in counts.items()], columns=["term", "pos", "neg"])


def _frequencies(terms):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, seen, docs = TermFinder(terms.value), Counter(), 0
        for rows in batches:
            docs += len(rows)
            for text in rows["text"]:
                seen.update(t for t, _ in find(text))
        yield pd.DataFrame([*seen.items(), (-1, docs)], columns=["term", "n"])

    return run


def _vectors(terms):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = TermFinder(terms.value)
        for rows in batches:
            found = [find(t) for t in rows["text"]]
            yield pd.DataFrame({
                "doc_id": rows["doc_id"], "toxic": rows["toxic"],
                "ids": [[t for t, _ in v] for v in found], "counts": [[c for _, c in v] for v in found],
            })

    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS) -> Model:
    """Fit on rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) covers and ``train`` admits.

    At most about ``max_examples`` labelled rows are used, drawn by a hash of the
    key. Rows with a null label or key are not labelled; a key labelled twice
    counts as toxic if any of its labels is. Without labelled rows, or without a
    term that speaks for a label, every score is the share of toxic labels (0).
    """
    spark = docs.sparkSession
    marked = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marked = marked.filter(train)
    total = max(1, marked.count())
    share = min(1.0, max_examples / total)
    drawn = marked.filter(F.pmod(F.xxhash64(F.lit("example"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # Bounded by max_examples, so the texts stay where they are.
    examples = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    counts = examples.mapInPandas(_partials, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    size = drawn.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    n, pos = size.n, size.pos
    neg = n - pos
    if not pos or not neg:
        return Model({}, Index(np.empty(0), [], [], [], []), [], float(pos > 0))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi2 = n * F.pow(a * (neg - b) - b * (pos - a), 2) / ((a + b) * (n - a - b + 1e-9) * float(pos) * float(neg))
    chosen = (
        counts.filter((a + b >= MIN_COUNT) & (a / (a + b) >= min(0.9, MIN_LIFT * pos / n))).withColumn("chi2", chi2).filter(F.col("chi2") >= MIN_CHI2)
        .orderBy(F.desc("chi2"), "term").limit(max_terms)
    )
    terms = {r.term: i for i, r in enumerate(chosen.collect())}
    sent = spark.sparkContext.broadcast(terms)
    df = docs.select("text").mapInPandas(_frequencies(sent), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = {r.term: r.n for r in df}
    idf = np.array([math.log((1 + df.get(-1, 0)) / (1 + df.get(t, 0))) + 1.0 for t in range(len(terms))])
    vectors = examples.mapInPandas(_vectors(sent), "doc_id long, toxic int, ids array<int>, counts array<long>")
    entries = vectors.groupBy("ids", "counts").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.min("doc_id").alias("first"))
    table = [(tuple(zip(r.ids, r.counts)), r.n, r.toxic, r.first) for r in entries.collect()]  # bounded by max_examples
    bare = [x for x in table if not x[0]]
    full = [x for x in table if x[0]]
    empty = (sum(x[2] for x in bare) + 0.5) / (sum(x[1] for x in bare) + 1.0)
    index = Index(idf, *([x[i] for x in full] for i in range(4)))
    return Model(terms, index, _calibrate(spark, index, full), empty)


def _calibrate(spark: SparkSession, index: Index, full: list) -> list[tuple[float, float]]:
    """Monotone map from votes to rates: every example scored without itself, votes in bins, adjacent violators pooled."""
    if not full:
        return []
    sent = spark.sparkContext.broadcast(index)
    rows = spark.createDataFrame([([t for t, _ in v], [c for _, c in v], n, toxic) for v, n, toxic, _ in full], "ids array<int>, counts array<long>, n long, toxic long")

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for ids, counts, n, toxic in zip(part["ids"], part["counts"], part["n"], part["toxic"]):
                vector = tuple(zip((int(i) for i in ids), (int(c) for c in counts)))
                for label, many in ((1, toxic), (0, n - toxic)):
                    if many:
                        out.append((sent.value.vote(vector, label)[0], many, many * label))
            yield pd.DataFrame(out, columns=["raw", "n", "toxic"])

    binned = rows.repartition(8).mapInPandas(votes, "raw double, n long, toxic long").groupBy(F.floor(F.col("raw") * 40).alias("bin"))
    bins = binned.agg((F.sum(F.col("raw") * F.col("n")) / F.sum("n")).alias("x"), F.sum("n").alias("n"), F.sum("toxic").alias("y")).orderBy("bin").collect()
    pools: list[list[float]] = []
    for r in bins:
        pools.append([r.x * r.n, r.n, r.y])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return [(x / n, (y + 0.5) / (n + 1.0)) for x, n, y in pools]


def score(spark: SparkSession, model: Model, text: Column, evidence: int = 3) -> Column:
    """struct(score, nearest, cosines) of a text; ``nearest`` are keys of labelled examples.

    Null and empty texts, and texts without a chosen term, get the rate of such
    texts among the examples. Equal texts score alike, whatever their other columns.
    """
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, nearest array<long>, cosines array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        find, memo = TermFinder(own.terms), {}
        for texts in batches:
            out = []
            for t in texts:
                vector = find(t)
                told = memo.get(vector)
                if told is None:
                    if len(memo) > MEMO // 4:
                        memo.clear()
                    if not vector:
                        told = (own.empty, [], [])
                    else:
                        raw, found, cosines = own.index.vote(vector)
                        told = (own.calibrated(raw), [own.index.first[i] for i in found[:evidence]], cosines[:evidence].tolist())
                    memo[vector] = told
                out.append(told)
            yield pd.DataFrame(out, columns=["score", "nearest", "cosines"])

    return run(text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, told): each row of ``docs`` as a struct, and its score; held-out rows teach nothing."""
    model = fit(docs.select("doc_id", "text"), labels, ~held_out(F.col("doc_id")))
    return docs.select(whole(docs).alias("doc"), score(docs.sparkSession, model, F.col("text")).alias("told"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    value = F.col("told.score")
    return out.select(
        "doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), value.alias("score"),
        (value >= THRESHOLD).cast("int").alias("predicted"), "told.nearest",
    )


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score stays below the threshold, with their columns."""
    out = scored(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return out.filter(F.col("told.score") < THRESHOLD).select("doc.*")
