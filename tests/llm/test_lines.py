import random

import numpy as np

from shardloom.llm import lines
from tests.llm.brute import documents, edit_distance, empty_documents


def variant(rng, line):
    b = list(line)
    for _ in range(rng.randint(0, 4)):
        i = rng.randrange(max(1, len(b)))
        k = rng.randint(0, 2)
        if k == 0 and b:
            b[i] = rng.choice("abcdé")
        elif k == 1 and b:
            del b[i]
        else:
            b.insert(i, rng.choice("abcdé"))
    return "".join(b)


def test_banded_distance_is_exact():
    rng = random.Random(9)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(3, 40)))
        pairs.append((a.encode(), variant(rng, a).encode()))
    for edits in (1, 2, 3):
        got = lines.within([a for a, _ in pairs], [b for _, b in pairs], edits)
        assert got.tolist() == [edit_distance(a, b) <= edits for a, b in pairs]


def brute(rows, edits=2, least=24):
    """{(doc_id, text): removed line numbers}"""
    first = {}
    for i, t in sorted({(i if i is not None else -1, t or "") for i, t in rows}):
        for k, l in enumerate(t.encode().split(b"\n")):
            if len(l) >= least:
                first.setdefault(l, []).append((i, t, k))
    names = list(first)
    late = {b for b in names for a in names if a != b and abs(len(a) - len(b)) <= edits and min(first[a]) < min(first[b]) and edit_distance(a, b) <= edits}
    out = {}
    for i, t in rows:
        own = (i if i is not None else -1, t or "")
        out[own] = [k for k, l in enumerate(own[1].encode().split(b"\n")) if len(l) >= least and (l in late or min(first[l]) != (*own, k))]
    return out


def test_against_brute_force(spark):
    rng = random.Random(10)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(18, 60))) for _ in range(25)]
    rows = []
    for i in range(60):
        own = [variant(rng, rng.choice(base)) for _ in range(rng.randint(0, 6))] + ["hot line that stands in every single document"]
        rng.shuffle(own)
        rows.append((i, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "no line end"), (None, base[0] + "x" * 30), (104, "q" * 90_000)]
    docs = documents(spark, [(i, t, "s") for i, t in rows])
    got = {(r.doc_id if r.doc_id is not None else -1, r.t or ""): list(r.removed or []) for r in lines.dedup_lines(docs).selectExpr("doc.doc_id", "doc.text as t", "removed").collect()}
    assert got == brute(rows)


def test_stage(spark):
    shared = "a line of more than twenty-four bytes that comes again"
    rows = [(1, f"{shared}\nown text of the first", "a"), (2, shared, "a"), (3, f"second text\n{shared[:-1]}\nend", "b"), (3, f"second text\n{shared[:-1]}\nend", "b"), (4, None, None), (5, "", "a")]
    out = lines.without_repeats(spark, documents(spark, rows), "")
    assert out.columns == documents(spark, rows).columns
    got = sorted((r.doc_id, r.text or "", r.n_chars) for r in out.collect())
    assert got == [(1, rows[0][1], len(rows[0][1])), (3, "second text\nend", 15), (3, "second text\nend", 15), (4, "", None), (5, "", 0)]
    assert lines.without_repeats(spark, empty_documents(spark), "").count() == 0


def test_lines_cut_like_split():
    texts = [b"", b"\n", b"a\n", b"\nb", b"a\n\nb", b"abc"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    row, number, start, length = lines.cut_lines(data, np.cumsum([0, *map(len, texts)]))
    got = {}
    for r, k, s, n in zip(row, number, start, length):
        got.setdefault(int(r), []).append(data[s : s + n].tobytes())
    assert [got[i] for i in range(len(texts))] == [t.split(b"\n") for t in texts]


def test_short_equal_lines_go(spark):
    rows = [(1, "All rights reserved.\n\n  \none", "a"), (2, "All rights reserved.\n\n  \ntwo", "a"), (3, "八个汉字\nthree", "b"), (4, "four\n八个汉字\nAll rights reserved!", "b")]
    out = lines.without_repeats(spark, documents(spark, rows), "")
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, rows[0][1]), (2, "\n  \ntwo"), (3, rows[2][1]), (4, "four\nAll rights reserved!")]
