import corpus_pipeline
from __spark_entry__ import queries
from shardloom.llm import jaccard
from shardloom.llm.common import read, settle
from tests.llm.brute import shingle_set, jaccard as similarity

SF_DIR = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = read(spark, SF_DIR, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, SF_DIR), "test")
        assert docs.columns == columns, name
        counts.append(docs.count())
        if name == "near_duplicates":
            sets = [shingle_set(r.text) for r in docs.collect()]
            assert not any(similarity(a, b) >= jaccard.SIMILARITY for k, a in enumerate(sets) for b in sets[:k])
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    last = corpus_pipeline.run(spark, SF_DIR)
    assert set(columns) < set(last.columns) and last.count() == counts[4]


def test_all_queries_are_registered():
    names = set(queries())
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11) if k != 2}
