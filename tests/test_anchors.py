import random

import pytest

from pathloom.operators import exempt

SHAPE = "as_id long, lo long, hi long"
MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def prints(rng, n, clusters, flips):
    """Words around few centres, some bits turned."""
    centres = [rng.getrandbits(128) for _ in range(clusters)]
    out = []
    for _ in range(n):
        w = rng.choice(centres)
        for _ in range(rng.randint(0, flips)):
            w ^= 1 << rng.randrange(128)
        out.append((signed(w & MASK), signed(w >> 64)))
    return out


def one_after_another(words, radius, most):
    chosen = []
    for lo, hi in sorted(set(words)):
        if len(chosen) < most and all(((lo ^ a) & MASK).bit_count() + ((hi ^ b) & MASK).bit_count() > radius for a, b in chosen):
            chosen.append((lo, hi))
    return set(chosen)


@pytest.mark.parametrize("radius,most,block", [(12, 2000, 30), (12, 7, 30), (3, 2000, 5000), (44, 2000, 40)])
def test_leaders_are_those_of_the_whole_order(spark, radius, most, block):
    rng = random.Random(radius)
    words = {1: prints(rng, 260, 12, 14), 2: prints(rng, 40, 2, 5), 3: prints(rng, 1, 1, 0)}
    rows = [(a, *w) for a, ws in words.items() for w in ws] + [(1, *words[1][0])] * 20
    got = exempt.anchors(spark.createDataFrame(rows, SHAPE), radius, most, block).collect()
    for a, ws in words.items():
        assert {(r.lo, r.hi) for r in got if r.as_id == a} == one_after_another(ws, radius, most)


@pytest.mark.parametrize("parts", [1, 2, 13, 24])
def test_words_that_differ_less_share_a_part(spark, parts):
    rng = random.Random(parts)
    rows = []
    for _ in range(60):
        w = rng.getrandbits(128)
        v = w
        for k in rng.sample(range(128), parts - 1):
            v ^= 1 << k
        rows.append((signed(w & MASK), signed(w >> 64), signed(v & MASK), signed(v >> 64)))
    d = spark.createDataFrame(rows, "a long, b long, c long, d long")
    from pyspark.sql import functions as F

    cut = d.select(exempt.word_parts(F.col("a"), F.col("b"), parts).alias("x"), exempt.word_parts(F.col("c"), F.col("d"), parts).alias("y"))
    assert all(len(r.x) == parts and set(r.x) & set(r.y) for r in cut.collect())
