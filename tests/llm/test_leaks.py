import re

import pytest
from pyspark.sql import functions as F

from shardloom.llm import leaks
from tests.compare import check, oracle
from tests.llm.brute import documents, empty_documents

SF_DIR = "/root/testdata/sf0.001"
ITEM = "Alpha beta, gamma DELTA epsilon zeta eta theta iota kappa lambda? mu"


def found_words(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [(m[0], m.start(), m.end()) for m in re.finditer(leaks.PATTERN, t)]


def brute(rows, items, width=10):
    held = {}
    for i, t in items:
        w = [x[0] for x in found_words(t)]
        for k in range(max(1, len(w) - width + 1)) if w else []:
            held.setdefault(tuple(w[k : k + width]), set()).add("" if i is None else str(i))
    out = []
    for i, t, _ in rows:
        w = found_words(t)
        hit, names = [False] * len(w), set()
        for k in range(len(w)):
            for n in {len(h) for h in held}:
                key = tuple(x[0] for x in w[k : k + n])
                if len(key) == n and key in held:
                    names |= held[key]
                    hit[k : k + n] = [True] * n
        spans, last = [], False
        for (_, a, b), h in zip(w, hit):
            if h and last:
                spans[-1] = (spans[-1][0], b)
            elif h:
                spans.append((a, b))
            last = h
        out.append((i is None, i, len(w), sum(hit), sorted(names), spans))
    return sorted(out, key=repr)


def told(df):
    rows = [(r.doc_id is None, r.doc_id, r.n_words, r.n_hit, list(r["items"]), [(s.start, s.end) for s in r.spans]) for r in df.collect()]
    return sorted(rows, key=repr)


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, window string, items int")


DOCS = [
    (1, f"é🙂 before; {ITEM} after", "s"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota", "s"),
    (3, "ALPHA-beta gamma.delta\nepsilon zeta eta theta iota kappa", "s"),
    (4, None, "s"),
    (5, "", "s"),
    (6, "...", "s"),
    (7, "two words", "s"),
    (7, "two words", "s"),
    (7, "two  Words two words, TWO", "t"),
    (None, f"{ITEM} {ITEM}", "s"),
    (8, "aa aa aa aa aa aa aa aa aa aa aa aa aa", "s"),
    (9, "ñandú Ñandú ñandÚ", "s"),
    (10, "filler " * 30_000 + ITEM + " filler" * 30_000, "s"),
]
ITEMS = [(1, ITEM), (11, ITEM.upper()), (2, "two words"), (3, None), (4, "?!"), (5, "aa " * 12), (None, "ñandÚ"), (2, "two words")]


@pytest.mark.parametrize("patterns", [leaks.PATTERNS, 2])
def test_equals_brute_force(spark, patterns):
    docs = documents(spark, DOCS).withColumns({"key": F.lit("k"), "hits": F.lit(0), "items": F.lit("i")})
    assert told(leaks.contamination(docs, bench(spark, ITEMS), patterns=patterns)) == brute(DOCS, ITEMS)


def test_other_widths(spark):
    assert told(leaks.contamination(documents(spark, DOCS), bench(spark, ITEMS), width=3)) == brute(DOCS, ITEMS, 3)


def test_empty_tables(spark):
    assert leaks.contamination(empty_documents(spark), bench(spark, ITEMS)).collect() == []
    none = told(leaks.contamination(documents(spark, DOCS), bench(spark, [(1, None)])))
    assert none == brute(DOCS, [])


def test_query_equals_sql(spark):
    assert check(spark, oracle(SF_DIR), SF_DIR, leaks.op13_leaks, leaks.OP13_SQL) is None
