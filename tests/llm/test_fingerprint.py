import hashlib
import random
import re

import pytest

from pathloom.llm.fingerprint import fingerprints


def jaccard(a, b):
    cut = lambda t: {x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)}
    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, got):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(t, edited), 9), round(jaccard(t, after), 9)))
    assert sorted(want) == sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got)
    return {t: {r.fingerprint for r in got if (r.doc_id, r.n_chars) == (i, len(t))} for i, t in order}


@pytest.mark.parametrize("n", [1, 2, 90])
def test_equals_brute_force(spark, n):
    rng = random.Random(n)
    line = lambda: "".join(rng.choice("ab é🙂") for _ in range(rng.randint(0, 12)))
    shared = [line() for _ in range(40)]
    rows = [(rng.randint(-50, 500) * 10 + k % 10, "\n".join(rng.choice([line, lambda: rng.choice(shared)])() for _ in range(rng.choice([1, 3, 10, 60])))) for k in range(n)]
    rows = list({i: (i, t) for i, t in rows}.values())
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, id int, r string").repartition(3)
    check(rows, fingerprints(df).collect())


def test_retries_nulls_repeats(spark):
    long = "\n".join(f"paragraph {i}" for i in range(3000))
    rows = [(9, long), (8, long.replace("7", "x")), (7, "a\nb"), (7, "a\nb"), (6, None), (5, ""), (4, "a\nb"), (None, "z")]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, got)
    assert len({r.fingerprint for r in got if r.n_chars == 3}) == 1 and len({r.fingerprint for r in got if r.n_chars == 0}) == 1
    assert max(r.level for r in got) >= 4


def test_empty(spark):
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
