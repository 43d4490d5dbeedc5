import itertools
import random
import re

import pytest

from pathloom.llm.components import components
from pathloom.llm.neardup import near_duplicates


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    """doc_id -> (set size, component)."""
    sets, root = {}, {}
    for i, t in rows:
        sets.setdefault(i, []).append(brute_set(t))
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(sorted(sets), 2):
        if any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[x] for b in sets[y]):
            p, q = sorted((find(x), find(y)))
            root[q] = p
    return {i: ([len(s) for s in sets[i]], find(i)) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÄß") for _ in range(rng.randint(1, 6)))
    rows, k = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 4, 5, 9, 40, 120]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            text = [word() if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            rows.append((k, rng.choice([" ", "\n", " \t "]).join(text).upper() if rng.random() < 0.3 else " ".join(text)))
            k += rng.randint(1, 3)
    return [*rows, (k + 1, ""), (k + 2, None), (k + 3, " \n "), (k + 5, "one"), (k + 4, "one"), (k + 6, "a b"), (k + 7, "word " * 400)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, h string, n_shingles long").repartition(3)
    want = brute(rows)
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles in want[r.doc_id][0] and r.component_id == want[r.doc_id][1] and r.kept == (r.component_id == r.doc_id)


def test_nulls_repeats_empty(spark):
    t = "a b c d e f g"
    rows = [(1, t), (1, t), (2, t), (None, t), (3, None), (3, None), (None, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (3, 3, True), (3, 3, True), (None, None, True)], key=str)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(250, 200), (250, 260), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 250: 200, 260: 200}
