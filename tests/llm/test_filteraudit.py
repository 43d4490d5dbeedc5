import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from pathloom.llm import filteraudit as A

SHAPE = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    good, bad = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    out, fails = {}, []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        f |= {"A"} if len(w) < 50 else set()
        f |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows) else set()
        fails.append((s or "", i, f))
    parts = {p for p, _, _ in fails}
    share = {(p, c): 0 for p in parts for c in "ABCDE"}
    for order in map("".join, permutations("ABCDE")):
        for k, c in enumerate(order):
            for p in parts:
                mine = [(i, f) for q, i, f in fails if q == p]
                here = [i for i, f in mine if c in f and not f & set(order[:k])]
                share[p, c] += len(here)
                out[p, order, k + 1] = [sum(not f & set(order[: k + 1]) for _, f in mine), len(here), sum(c in f and bool(f & set(order[:k])) for _, f in mine), sum(f == {c} for _, f in mine), sum(i in good for i in here), sum(i in bad for i in here)]
    return {(p, o, k): (*v, share[p, o[k - 1]]) for (p, o, k), v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def corpus():
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "d#lta", "ÉPS", "zeta"] + [f"w{k}" for k in range(90)])
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(rng.choice([3, 40, 60, 90, 400])) for _ in range(14)]
    base += [base[4] + "x", base[4] + "y", "a" * 511 + "b", "a" * 511 + "c", "a" * 700 + "b", "a" * 700 + "c", "", None, " \x1c \x0b", "one two\x85three\n" * 60, "A b " * 80]
    return [(rng.choice([*range(40), None]), rng.choice(base), rng.choice(["s", "t", None, ""])) for _ in range(120)]


@pytest.mark.parametrize("bits", [64, 3])
def test_equals_brute_force(spark, bits, monkeypatch):
    """With hashes of 3 bits texts that differ share classes all the time; only the texts themselves tell."""
    rows, labels = corpus(), [(i, i % 2, int(i % 7 == 0)) for i in range(30)] + [(4, 1, 0), (4, 0, 0), (None, 1, 1)]
    facts = A._facts
    monkeypatch.setattr(A, "_facts", lambda d, _: facts(d, bits))
    texts = A._texts
    monkeypatch.setattr(A, "_texts", lambda d, c, _: texts(d, c, bits))
    d = spark.createDataFrame(rows, SHAPE).repartition(3)
    assert got(A.report(d, spark.createDataFrame(labels, LABELS))) == brute(rows, labels)


def test_refinement_leaves_copies_only(spark):
    texts = ["q" * 600 + c for c in "aabc"] + ["z", "z", "y"] + ["é" * 300, "é" * 300, "e" * 300] + ["w" * 9000] * 2 + ["w" * 8999 + "v"]
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SHAPE)
    from pathloom.llm.shared import materialize

    classes = {r["class"] for r in A.refine(materialize(A._facts(d, 64), "t")).collect()}
    assert classes == {A.chain(t.encode(), len(t))[-1] for t in ("q" * 600 + "a", "z", "é" * 300, "w" * 9000)}
    assert sorted(r.doc_id for r in A.failing(d).where("mask & 16 > 0").collect()) == [1, 5, 8, 11]


def test_words_of_long_texts(monkeypatch):
    monkeypatch.setattr(A, "STRIDE", 7)
    t = b"ab cd\tab  efghijklmnopqrstuv ab\n" * 12
    assert A.mask(t, len(t)) == 2 and A.mask(b"x" * 100, 100) == 1 and A.mask(b"", 0) == 1


def test_edge_cases(spark):
    empty = spark.createDataFrame([], LABELS)
    assert A.report(spark.createDataFrame([], SHAPE), empty).collect() == []
    one = got(A.report(spark.createDataFrame([(1, None, None)], SHAPE), empty))
    assert len(one) == 600 and one["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and one["", "EDCBA", 5] == (0, 1, 0, 1, 0, 0, 120) and one["", "BACDE", 1] == (1, 0, 0, 0, 0, 0, 0)


def test_clashing_names(spark):
    rows = [(i, "word " * 60, "s") for i in range(5)]
    d = spark.createDataFrame(rows, SHAPE)
    more = d.withColumns({"part": F.lit("x"), "mask": F.lit("y"), "class": F.lit(1), "chain": F.lit(2), "least": F.lit(3), "a.b": F.create_map(F.lit("k"), F.lit(1)), "quality": F.lit(1), "toxic": F.lit(1)})
    labels = spark.createDataFrame([(1, 1, 1)], LABELS).withColumns({"text": F.lit("t"), "part": F.lit("q")})
    assert got(A.report(more, labels)) == brute(rows, [(1, 1, 1)])
