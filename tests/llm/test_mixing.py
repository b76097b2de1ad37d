import random

from pyspark.sql import functions as F

from shardloom.llm import mixing
from tests.llm.brute import documents, empty_documents


def targets(sizes, cap=3.0):
    """The excess over each cap is shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return {**{s: cap * sizes[s] for s in full}, **share}
        full.update(over)


def run(spark, rows):
    out = mixing.mix(documents(spark, rows), "doc_id", "source", mixing.word_count(F.col("text")))
    return out.collect()


def test_targets_and_taken_words(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 8, 20, 21, 400])), rng.choice(["b", "a", "a", "a", "a", "é", "Z", None])) for i in range(3000)]
    rows += [(9000 + i, "one two", "tiny") for i in range(3)]
    got = run(spark, rows)
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * want[r.source]
        assert 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(3, 0.01 * t), (s, taken[s], t)
    assert sorted(map(tuple, run(spark, rows))) == sorted(map(tuple, got)) if None not in sizes else len(run(spark, rows)) == len(got)


def test_reruns_agree_row_by_row(spark):
    rows = [(i, "a b c " * (i % 7), f"s{i % 4}") for i in range(500)]
    assert sorted(map(tuple, run(spark, rows))) == sorted(map(tuple, run(spark, rows)))


def test_nulls_repeats_empty_texts_and_tables(spark):
    rows = [(None, None, None), (1, "", "a"), (1, "x y z", "a"), (1, "x y z", "a"), (2, "w " * 50_000, "a"), (3, None, "b")]
    got = run(spark, rows)
    assert len(got) == len(rows) and sum(r.size for r in got) == 50_006
    assert run(spark, []) == []
    only_empty = run(spark, [(1, "", "a"), (2, None, None)])
    assert [r.size * r.copies for r in only_empty] == [0, 0]


def test_stage_repeats_rows_and_keeps_columns(spark):
    docs = documents(spark, [(i, "a b c d", "x" if i < 90 else "y") for i in range(100)] + [(5, "a b c d", "x")])
    out = mixing.mix_sources(spark, docs, "")
    assert out.columns == docs.columns
    words = {r.source: r.n * 4 for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    want = targets({"x": 364, "y": 40})
    assert all(abs(words[s] - want[s]) <= 4 for s in want)
    assert mixing.mix_sources(spark, empty_documents(spark), "").count() == 0
