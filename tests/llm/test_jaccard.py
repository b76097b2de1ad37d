import random

import numpy as np

from shardloom.llm import jaccard
from shardloom.llm.common import row_key
from tests.llm.brute import components, documents, empty_documents, shingle_set
from tests.llm.brute import jaccard as similarity


def corpus(seed=11):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    hot = [rng.choice(words) for _ in range(80)]
    for _ in range(150):
        own = list(hot)
        own[rng.randrange(80)] = rng.choice(words)
        rows.append(" ".join(own))
    rows += ["exact copy of some text here"] * 30 + ["Exact  copy of\nsome TEXT here"] * 3
    return [(i, t) for i, t in enumerate(rows)] + [(5000, None), (5001, ""), (5002, " \n "), (5003, "one")]


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if similarity(sets[a], sets[b]) >= 0.8]
    links = {i: 0 for i in ids}
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    return links, components(ids, edges)


def run(spark, rows):
    docs = documents(spark, [(i, t, "s") for i, t in rows]).select("doc_id", "text").withColumn("__row", row_key())
    return {r.doc_id: r for r in jaccard.near_duplicates(docs).collect()}


def test_links_and_components(spark):
    rows = corpus()
    links, parts = brute(rows)
    got = run(spark, rows)
    assert {i: r.n_links for i, r in got.items()} == links
    assert {i: r.component for i, r in got.items()} == parts


def test_small_limits_take_the_paths_for_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 8)
    monkeypatch.setattr(jaccard, "DEPTH", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "TOGETHER", 40)
    rows = corpus(12)
    links, parts = brute(rows)
    got = run(spark, rows)
    assert {i: r.n_links for i, r in got.items()} == links
    assert {i: r.component for i, r in got.items()} == parts


def test_stage_keeps_one_of_each(spark):
    same = "the same words in the very same order once more"
    rows = [(3, same, "a"), (1, same, "b"), (1, same, "b"), (2, "something else that stands alone here", "a"), (None, same, "c"), (4, None, None), (5, "", "a"), (6, "word " * 40_000, "a")]
    docs = documents(spark, rows)
    out = jaccard.one_of_each(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect()) == [-1, 2, 4, 5, 6]
    assert jaccard.one_of_each(spark, empty_documents(spark), "").count() == 0


def test_shingles_like_split():
    texts = ["", "a b", "A b  c\td e f", "x y z x y z x y z", " lead and trail ", "a b c d e f a b c d e"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    hashes, ends = jaccard.shingles(data, np.cumsum([0, *map(len, raw)]))
    sizes = np.diff(np.concatenate([[0], ends]))
    assert sizes.tolist() == [len(shingle_set(t)) if t.islower() or not t else len({tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}) for t in texts]
    assert len(set(hashes.tolist())) == len({s for t in texts if t for s in {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}})
