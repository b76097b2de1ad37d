import hashlib

import pytest
from pyspark.sql import functions as F

from shardloom.llm import middle
from tests.compare import check, oracle
from tests.llm.brute import documents, empty_documents

SF_DIR = "/root/testdata/sf0.001"
TEXTS = ["", None, "a", "é🙂", "plain words only", "<P>", "x<S>y", "<", "<S", "S>", "<<P", "P><", "<M" * 9, "\u0000\n🙂é" * 50, "ab<" * 30, ">" * 40, "long text é " * 30_000]


def brute(doc_id, text, seed=1):
    t = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_every_form_and_restoring(spark):
    rows = [(100 * i + k, t, "s") for i in range(12) for k, t in enumerate(TEXTS)]
    made = middle.restore(middle.fill_in_middle(documents(spark, rows)))
    got = {r.doc_id: r for r in made.collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(i, t)
        assert r.restored == (t or "")
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_null_keys_repeats_and_clashing_columns(spark):
    rows = [(None, "some text here", "a"), (7, "same", "b"), (7, "same", "b"), (7, "other", "c")]
    docs = documents(spark, rows).withColumns({"key": F.lit(1), "drawn": F.lit(2), "output": F.lit("z"), "restored": F.lit("y"), "form": F.lit("psm")})
    got = sorted((r.doc_id is None, r.output, r.restored) for r in middle.restore(middle.fill_in_middle(docs)).collect())
    assert got == sorted((i is None, brute(i, t)[4], t) for i, t, _ in rows)


def test_empty_table(spark):
    assert middle.restore(middle.fill_in_middle(empty_documents(spark))).collect() == []


def test_another_seed_cuts_elsewhere(spark):
    rows = [(i, "one two three four five six", "s") for i in range(40)]
    got = {r.doc_id: r.output for r in middle.fill_in_middle(documents(spark, rows), seed=9).collect()}
    assert got == {i: brute(i, t, 9)[4] for i, t, _ in rows}


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_small_chunks_do_not_change_anything(monkeypatch, size):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(middle, "CHUNK", size)
    texts = [t or "" for t in TEXTS[:-1]]
    drawn = [hashlib.sha256(f"1:{k}".encode()).digest()[:16] for k in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), pa.array([t.encode() for t in texts]), pa.array(drawn)], ["key", "text", "drawn"])
    out = [x for b in middle._forward(iter([batch])) for x in b.column("output").to_pylist()]
    assert [x.decode() for x in out] == [brute(k, t)[4] for k, t in enumerate(texts)]


def test_query_equals_sql(spark):
    assert check(spark, oracle(SF_DIR), SF_DIR, middle.op11_middle, middle.OP11_SQL) is None
