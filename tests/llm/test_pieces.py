import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from shardloom.llm import pieces
from tests.llm.brute import documents


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.default_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_ids_equal_the_library(vocabulary, library):
    rng = random.Random(7)
    texts = ["", None, " ", "  a   b ", "x" * 500, "abc" * 400, "\n\n a\n", "日本語🙂ẞ", "the" * 200 + " ▁▁" * 20, "a\x00b\t\r\n", "é" * 70, "the theand " * 3000]
    texts += ["".join(rng.choice("abcdeinrst  \n'.é🙂0") for _ in range(rng.randint(1, 300))) for _ in range(400)]
    encode = pieces.Encoder(vocabulary)
    for _ in range(2):  # the second time all units are known
        ids, at = encode(texts)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(t or ""), t
    assert pieces.decode(vocabulary, ids, at) == [library.decode(library.encode(t or "")) for t in texts]


def test_suffix_array_and_occurrences(vocabulary):
    rng = random.Random(8)
    units = ["".join(rng.choice("ent▁hi") for _ in range(rng.randint(1, 30))) for _ in range(60)]
    sizes = np.array([len(u) for u in units])
    codes = np.array([ord(c) + 1 for u in units for c in u])
    ends = np.cumsum(sizes)
    left = np.concatenate([np.arange(s, 0, -1) for s in sizes])
    start, piece = pieces.occurrences(vocabulary, codes, left)
    got = sorted(zip(start.tolist(), piece.tolist()))
    known = {t: i for i, t in enumerate(vocabulary.texts)}
    want = [
        (int(e - len(u)) + a, known[u[a : a + n]])
        for u, e in zip(units, ends) for a in range(len(u)) for n in range(1, vocabulary.depth + 1) if a + n <= len(u) and u[a : a + n] in known
    ]
    assert got == sorted(want)


def test_table_with_odd_rows(spark, library):
    rows = [(1, None, "a"), (2, "", None), (None, "word", "a"), (3, "same", "a"), (3, "same", "a"), (4, "long " * 30_000, "b")]
    out = pieces.with_pieces(documents(spark, rows), check=True)
    got = sorted((r.doc_id or 0, r.text or "", r.ids, r.round_trip) for r in out.collect())
    assert got == sorted((i or 0, t or "", library.encode(t or ""), True) for i, t, _ in rows)
    assert pieces.with_pieces(documents(spark, rows).limit(0)).count() == 0


def test_memory_follows_the_slice_not_the_batch(vocabulary, library):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeinrstlodu") for _ in range(rng.randint(3, 12))) for _ in range(120_000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(1500)]
    texts[7:9] = [None, "one text " * 150_000]
    tracemalloc.start()
    out = list(pieces.encoded(vocabulary, iter([pa.array(texts)]), True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 180e6  # 138 MB measured; 262 with slices of 6,000,000 characters
    assert all(out[k].field("round_trip").to_pylist() == [True] * len(out[k]) for k in range(len(out)))
    ids = [row for part in out for row in part.field("ids").to_pylist()]
    assert len(ids) == len(texts) and all(ids[k] == library.encode(texts[k] or "") for k in (0, 7, 8, 9, 700, 1499))
