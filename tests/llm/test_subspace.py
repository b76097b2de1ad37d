import numpy as np

from shardloom.llm import subspace
from tests.llm.brute import components

SCHEMA = "vec_id long, embedding array<float>, label int, node string, copies string, part string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "n", "c", "p") for i, v in rows], SCHEMA)


def vectors(seed, n=220, dims=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims)).astype(np.float32)
    near = base[:60] + rng.normal(size=(60, dims)) * rng.uniform(0, 0.4, (60, 1))
    hot = base[0] + rng.normal(size=(80, dims)) * 0.05
    every = np.concatenate([base, near, hot, base[5:8], base[5:8] * 3]).astype(np.float32)
    return [(i, v) for i, v in enumerate(every)]


def brute(rows):
    ids = [i for i, _ in rows]
    x = np.stack([v for _, v in rows]).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T >= 0.9
    np.fill_diagonal(c, False)
    return dict(zip(ids, c.sum(1).tolist())), components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(c)) if a > b])


def check(spark, rows):
    links, parts = brute(rows)
    got = subspace.near_vectors(table(spark, rows)).collect()
    assert {r.vec_id: r.n_links for r in got} == links
    assert {r.vec_id: r.component_id for r in got} == parts


def test_against_brute_force(spark):
    check(spark, vectors(1))


def test_cells_in_parts(spark, monkeypatch):
    monkeypatch.setattr(subspace, "PART", 40)
    monkeypatch.setattr(subspace, "TILE", 7)
    check(spark, vectors(2))
    check(spark, vectors(3, dims=3))


def test_odd_rows(spark):
    rows = [(1, [1, 0, 0]), (2, [2, 0, 0]), (3, [0, 0, 0]), (4, None), (5, [1, None, 0]), (6, [float("nan"), 1, 0]), (7, [float("inf"), 0, 0]), (8, [1, 0]), (9, []), (2, [2, 0, 0]), (None, [1, 0.01, 0]), (10, [1e-30, 0, 0]), (11, [0, 1, 0])]
    got = {(r.vec_id, r.n_links, r.component_id) for r in subspace.near_vectors(table(spark, rows)).collect()}
    linked = {(i, 3, None) for i in (1, 2, 10, None)}
    assert got == linked | {(i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9, 11)}
    assert subspace.near_vectors(table(spark, [])).count() == 0
