"""Plain versions of what the operators compute, and small inputs with odd rows."""

from __future__ import annotations

import hashlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __row long, line string, node string, ids string, size string, target string, words string, told string, removed string, copies string"


def documents(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    full = [(i, t, "en", s, None if t is None else len(t), 7, "x", "y", "z", "s", "t", "w", "o", "r", "c") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def edit_distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def shingle_set(text, words=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def cut_repeats(rows, length=50):
    """{doc_id: (bytes, removed, spans, digest)} for (doc_id, text) rows with distinct ids."""
    first, out = {}, {}
    for i, text in sorted(rows):
        t = (text or "").encode()
        gone, fresh = bytearray(len(t)), []
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in first:
                gone[p : p + length] = b"\1" * length
            else:
                fresh.append(w)
        first.update(dict.fromkeys(fresh, i))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
