import random
import re

from shardloom.llm import licenses
from tests.llm.brute import documents


def bigrams(text):
    w = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


def brute(rows):
    sets = {n: bigrams(t) for n, t in licenses.TEMPLATES.items()}
    out = []
    for i, text, _ in rows:
        plain = re.sub(r"[^a-z0-9\n]+", " ", (text or "").lower())
        blocks = re.split(r"\n[ \n]*\n", plain)
        units = [("line", k, u) for k, u in enumerate(plain.split("\n"))]
        units += [("paragraph", k, u) for k, u in enumerate(blocks) if "\n" in u]
        units += [("text", 0, plain)] if len(blocks) > 1 else []
        for kind, k, u in units:
            own = bigrams(u)
            best = max(((2 * len(own & s) / (len(own) + len(s)), [-ord(c) for c in n], n) for n, s in sets.items()), default=None) if own else None
            if best and best[0] >= licenses.DICE:
                out.append((i, kind, k, best[2], round(best[0], 9), len(own)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(16)
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 5)):
            words = rng.choice(list(licenses.TEMPLATES.values())).split()
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(["the", "x", "License", "(c)"])
            cut = rng.randint(0, len(words))
            lines.append(" ".join(words[:cut]) + rng.choice([" ", "\n", "\n\n", " \n * \n"]) + " ".join(words[cut:]))
        rows.append((i, "\n".join(lines), "s"))
    rows += [(200, None, "s"), (201, "", None), (202, "MIT", "s"), (None, "Released under the MIT License.", "s"), (203, "ab " * 60_000, "s"), (203, "ab " * 60_000, "s")]
    rows += [(204, "\n".join(licenses.TEMPLATES.values()), "s"), (205, "released  UNDER the\n\n\nmit license", "s"), (205, "released  UNDER the\n\n\nmit license", "s")]
    got = licenses.scan(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.unit, r.number, f"{r.license} {r.part}", round(r.dice, 9), r.n_bigrams) for r in got), key=repr) == brute(rows)
    assert len(got) > 100


def test_no_rows_and_no_python(spark):
    scanned = licenses.scan(documents(spark, []))
    assert scanned.count() == 0
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_texts_without_an_anchor_are_dropped_before_they_are_split(spark):
    # Less than the bigrams needed for the coefficient hold none of the anchors.
    for texts in (list(licenses.TEMPLATES.values()), ["to be or not to be", "it is", "by the the way", "one"]):
        sets = [licenses.template_bigrams(t) for t in texts]
        for dice in (0.05, 0.5, 0.8, 1.0):
            words = set(licenses.anchors(sets, dice))
            for s in filter(None, sets):
                assert sum(not words & set(b.split()) for b in s) < dice / (2 - dice) * len(s)
    plan = licenses.scan(documents(spark, []))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Contains(spaced") < plan.index("paragraph") < plan.index("RLIKE(lower(text")


def test_templates_of_common_words(spark):
    rows = [(1, "To be, or not to be!\nit is", "s"), (2, "be or not to", "s"), (3, "the way by the", "s"), (4, "nothing of it", "s")]
    templates = {"A x": "to be or not to be", "B y": "it is", "C z": "by the way"}
    for dice in (0.5, 0.8):
        want = set()
        for i, text, _ in rows:
            for k, unit in enumerate(text.split("\n")):
                own = bigrams(unit)
                best = max((2 * len(own & bigrams(t)) / (len(own) + len(bigrams(t))), [-ord(c) for c in n], n) for n, t in templates.items())
                if best[0] >= dice:
                    want.add((i, k, best[2][0]))
        got = licenses.scan(documents(spark, rows), templates=templates, dice=dice).filter("unit = 'line'").collect()
        assert {(r.doc_id, r.number, r.license) for r in got} == want and want
