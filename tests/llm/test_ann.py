import numpy as np

from shardloom.llm import ann
from tests.llm.test_subspace import table


def exact(rows, k=10, every=100):
    ids = np.array([i for i, _ in rows])
    x = np.stack([v for _, v in rows]).astype(float)
    out = {}
    for q in ids[ids % every == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        order = np.lexsort((ids, d))[:k]
        out[int(q)] = [(int(ids[o]), float(d[o])) for o in order if np.isfinite(d[o])]
    return out


def found(spark, rows):
    out = {}
    for r in sorted(ann.nearest(table(spark, rows), lambda key: key % 100 == 0).collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(13)
    every = rng.normal(size=(1500, 16)).astype(np.float32)
    every[700:1000] = every[3]  # one vector under many ids
    every[1000:1100] = every[3] + rng.normal(size=(100, 16)).astype(np.float32) * 1e-3
    rows = list(enumerate(every))
    want, got = exact(rows), found(spark, rows)
    assert want.keys() == got.keys()
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q, hit in got.items():
        x = every[q].astype(float)
        assert all(abs(np.sqrt(((every[i].astype(float) - x) ** 2).sum()) - s) < 1e-12 for i, s in hit)
        assert hit == sorted(hit, key=lambda h: (h[1], h[0]))
    assert got[800] == [(i, 0.0) for i in [3, *range(700, 709)]]


def test_few_rows_give_all(spark):
    rows = [(0, [1, 2]), (100, [1, 2]), (3, [5, 5]), (4, [-1, 0])]
    assert found(spark, rows) == exact([(i, np.array(v)) for i, v in rows])


def test_odd_rows(spark):
    rows = [(0, [1, 0]), (100, [0, 0]), (200, None), (300, [None, 1]), (400, [float("nan"), 1]), (500, [1, 2, 3]), (None, [1, 1]), (1, [2, 0]), (0, [1, 0])]
    assert found(spark, rows) == {0: [(1, 1.0)]}
    assert found(spark, []) == {}
    assert found(spark, [(100, [0, 0])]) == {}
