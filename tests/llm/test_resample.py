import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import resample as rs
from tests.llm.brute import documents, empty_documents

SF_DIR = "/root/testdata/sf0.001"
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def buckets(text):
    w = re.findall(PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute(rows, targets):
    s, t = Counter(), Counter()
    told = [(i, x, *buckets(x)) for i, x in rows]
    for *_, b in told:
        s.update(b)
    for x in targets:
        t.update(buckets(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))

    out = []
    for i, _, n, b in told:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, b))
        out.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


def told(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=repr)


def bench(spark, texts):
    return spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "item_id long, text string, rank int")


def test_crc_of_any_strings_one_after_the_other():
    rng = np.random.default_rng(5)
    a = [rng.bytes(int(n)) for n in rng.integers(0, 700, 300)]
    b = [rng.bytes(int(n)) for n in rng.integers(0, 2000, 300)]
    got = rs.followed(np.array([zlib.crc32(x) for x in a], np.uint32), np.array([zlib.crc32(x) for x in b], np.uint32), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


ROWS = [(k, " ".join(f"W{(k * j) % 37}" for j in range(1, 15 + k % 12)) + ".", "s") for k in range(1, 400)]
ROWS += [(None, None, "s"), (None, "a b c d e f g h i j k l m n o p q r s t", "s"), (900, "", "s"), (901, "...", "s"), (902, "ein Wort", "s")]
ROWS += [(903, "x" * 3000 + " y" * 30, "s"), (904, "é🙂 Ñ ñ 字 " * 9000, "s"), (904, "é🙂 Ñ ñ 字 " * 9000, "s"), (905, "a" * 255 + " " + "b" * 256, "s")]
TARGET = ["w1 w2 w3 w4 w6", None, "", "字 é🙂 Ñ", "w5 w10 w15 w20"]


@pytest.mark.parametrize("words, pairs", [(rs.HEAD_WORDS, rs.HEAD_PAIRS), (5, 3), (1, 0)])
def test_equals_brute_force_wherever_the_head_ends(spark, monkeypatch, words, pairs):
    monkeypatch.setattr(rs, "HEAD_WORDS", words)
    monkeypatch.setattr(rs, "HEAD_PAIRS", pairs)
    docs = documents(spark, ROWS).withColumns({"key": F.lit(1), "weight": F.lit("w"), "rank": F.lit("r"), "__at": F.lit(0)})
    assert told(rs.resample(docs, bench(spark, TARGET))) == brute([(i, t) for i, t, _ in ROWS], TARGET)


def test_ties_repeats_and_null_keys_are_drawn_in_order(spark):
    rows = [(k % 40, "same words " * 20, "s") for k in range(200)] + [(None, "same words " * 20, "s")] * 5
    got = told(rs.resample(documents(spark, rows), bench(spark, ["words"])))
    assert [r[:4] for r in got] == [r[:4] for r in brute([(i, t) for i, t, _ in rows], ["words"])]
    drawn = sorted((r for r in got if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in drawn] == list(range(1, 11))
    assert [r[3] for r in drawn] == sorted((r[3] for r in got), reverse=True)[:10]


def test_empty_tables(spark):
    assert rs.resample(empty_documents(spark), bench(spark, TARGET)).collect() == []
    some = [(i, t, s) for i, t, s in ROWS[:30]]
    assert told(rs.resample(documents(spark, some), bench(spark, []))) == brute([(i, t) for i, t, _ in some], [])


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    target = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert told(rs.op12_resample(spark, SF_DIR)) == brute([(r.doc_id, r.text) for r in docs], target)
