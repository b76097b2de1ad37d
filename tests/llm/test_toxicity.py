import random

import numpy as np
import pytest

from shardloom.llm import toxicity
from tests.llm.brute import documents


def test_index_finds_the_exact_nearest():
    rng = random.Random(5)
    vectors = sorted({tuple(sorted((t, rng.randint(1, 4)) for t in rng.sample(range(30), rng.randint(1, 5)))) for _ in range(900)})
    idf = np.array([1 + rng.random() * 4 for _ in range(30)])
    index = toxicity.Index(idf, vectors, [1] * len(vectors), [rng.randint(0, 1) for _ in vectors], list(range(len(vectors))))
    dense = np.zeros((len(vectors), 30))
    for v, at in index.entry.items():
        ids, w = index.weights(v)
        dense[at, ids] = w
    for v in rng.sample(vectors, 120):
        found, cosines = index.nearest(v)
        q = np.zeros(30)
        ids, w = index.weights(v)
        q[ids] = w
        every = dense @ q
        want = np.lexsort((np.arange(len(every)), -np.round(every, 12)))[: toxicity.NEIGHBOURS]
        assert np.allclose(np.sort(cosines)[::-1], np.sort(every[want])[::-1], atol=1e-9)
        assert len(set(found)) == toxicity.NEIGHBOURS


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(6)
    plain = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = i % 8 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["grubber", "grubbing", "Vexed!", "snarl"])
            words[rng.randrange(len(words))] = rng.choice(["grubby", "vexed", "snarl"])
        rows.append((i, " ".join(words), f"s{i % 3}"))
        if i % 5:
            labels.append((i, int(toxic)))
    odd = [(None, None, None), (5000, "", "a"), (5001, "grubber " * 30_000, "a"), (5001, "grubber " * 30_000, "a"), (5002, None, "a")]
    marked = spark.createDataFrame([*labels, (None, 1), (3, None), (1, 0), (1, 0)], "doc_id long, toxic int")
    return documents(spark, rows + odd), marked, dict(labels)


def test_held_out_rows_are_told_apart(spark, planted):
    docs, labels, truth = planted
    out = toxicity.scored(docs, labels).select("doc.doc_id", "told.score", "told.nearest", toxicity.held_out(toxicity.F.col("doc.doc_id")).alias("h")).collect()
    assert len(out) == docs.count()
    held = [(r.score, truth[r.doc_id]) for r in out if r.h and r.doc_id in truth]
    assert len(held) > 150 and all(0 <= r.score <= 1 for r in out)
    right = sum((s >= toxicity.THRESHOLD) == bool(y) for s, y in held)
    assert right / len(held) > 0.97
    scores = {}
    for r in out:
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert max(scores[5001]) > 0.9 and len(scores[5001]) == 1
    assert scores[5000] == scores[5002] == scores[None] and max(scores[5000]) < 0.1


def test_stage_keeps_clean_rows_and_columns(spark, planted, tmp_path):
    docs, labels, truth = planted
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = toxicity.reject_toxic(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    clean = [i for i in range(1200) if i % 8]
    assert sum(i in ids for i in clean) / len(clean) > 0.98
    assert sum(i in ids for i in range(0, 1200, 8)) < 15


def test_without_labels_nothing_is_toxic(spark):
    docs = documents(spark, [(1, "a", "s"), (2, None, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.s for r in toxicity.scored(docs, none).select(toxicity.F.col("told.score").alias("s")).collect()] == [0.0, 0.0]
    assert toxicity.scored(docs.limit(0), none).count() == 0
