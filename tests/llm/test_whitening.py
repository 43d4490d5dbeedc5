import math
from fractions import Fraction

import numpy as np
import pytest

from pathloom.llm import whitening as W

SHAPE = "vec_id long, embedding array<double>"


def brute(vectors, components=4):
    """Exact sums by fractions, then eigh; the whitened values up to their sign."""
    x = [[math.floor(Fraction(c) * 256) for c in v] for v in vectors]
    listed = [list(t) for t in {tuple(r) for r in x}]
    n, d = len(listed), len(x[0])
    s = [sum(r[k] for r in listed) for k in range(d)]
    mean = [Fraction(a, n) for a in s]
    v = np.array([[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in listed) / n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1].T[:components]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    centred = np.array([[float(a - m) for a, m in zip(r, mean, strict=True)] for r in x])
    return n, deviation, centred @ u.T / np.sqrt(e), e / np.trace(v)


def check(spark, vectors, parts=3):
    d = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], SHAPE).repartition(parts)
    got = {(r.vec_id, r.component): r for r in W.report(d).collect()}
    n, deviation, whitened, explained = brute(vectors)
    k = min(4, len(vectors[0]))
    assert len(got) == len(vectors) * k
    for c in range(k):
        mine = np.array([got[i, c + 1].whitened for i in range(len(vectors))])
        sign = np.sign(mine @ whitened[:, c])
        assert np.allclose(mine * sign, whitened[:, c], rtol=1e-7, atol=1e-9)
    for (i, c), r in got.items():
        assert (r.n, r.deviation) == (n, deviation[i] if deviation[i] < 1 << 63 else None) and r.explained == pytest.approx(explained[c - 1], rel=1e-9) and r.identity_error < 1e-6
    return got


def test_equals_fractions(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 6)) @ np.diag([3, 2, 1, 0.5, 0.3, 0.1])
    v = np.concatenate([v, v[:7], np.tile(v[3], (40, 1))])  # copies count once in the fit
    a, b = check(spark, v.tolist(), 1), check(spark, v.tolist(), 5)
    assert {k: (r.deviation, r.n) for k, r in a.items()} == {k: (r.deviation, r.n) for k, r in b.items()}
    assert all(a[k].whitened == b[k].whitened for k in a)  # the fit is exact, so partitions don't matter


def test_large_offsets_lose_nothing(spark):
    """Entries near 2**40: in doubles the cross-products' difference would be lost."""
    rng = np.random.default_rng(2)
    check(spark, (rng.integers(-40, 40, size=(50, 5)) / 8 + 2.0**40).tolist())


def test_sums_are_exact_at_any_size():
    rng = np.random.default_rng(3)
    for top in (5, 1 << 21, 1 << 23, 1 << 40, (1 << 62) - 1):
        x = rng.integers(-top, top, size=(1300, 3))
        s = W.Scatter(x[0].copy())
        for at in range(0, 1300, 700):
            s.add(x[at : at + 700])
        z = np.concatenate([np.ones((1300, 1), object), x.astype(object)], axis=1)
        assert (s.matrix() == z.T @ z).all()
    wide = W.Scatter(np.zeros(2, np.int64))
    x = np.array([[(1 << 63) - 1, -(1 << 63)], [5, -(1 << 63)]])
    wide.add(x)
    assert (wide.matrix()[1:, 1:] == x.astype(object).T @ x.astype(object)).all()


def test_many_blocks_are_carried():
    x = np.full((W.BLOCK * (W.FLUSH + 3), 1), 3, np.int64)
    s = W.Scatter(np.array([-(1 << 22) + 4]))
    s.add(x)
    assert s.matrix()[1, 1] == 9 * len(x) and s.matrix()[0, 1] == 3 * len(x)


def test_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, [1.0, None]), (3, [1.0, nan]), (4, [inf, 0.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (None, [3.0, -1.0]), (7, [0.5, 0.5, 0.5]), (8, []), (9, [0.0, 7.0])]
    got = W.report(spark.createDataFrame(rows, SHAPE)).collect()
    assert sorted({str(r.vec_id) for r in got}) == ["5", "9", "None"] and len(got) == 8 and {r.n for r in got} == {3}  # one vector of three entries, one of none: no component
    assert W.report(spark.createDataFrame([], SHAPE)).collect() == []
    flat = W.report(spark.createDataFrame([(i, [float(i), 4.0, float(-i)]) for i in range(5)], SHAPE)).collect()
    assert {r.component for r in flat} == {1} and all(r.explained == pytest.approx(1) for r in flat)
    huge = W.report(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], SHAPE)).collect()
    assert {r.component for r in huge} == {1} and all(r.deviation is None for r in huge if r.vec_id < 3)
    assert W.quantised(spark.createDataFrame([(1, [-0.0, 0.001, -0.001])], SHAPE)).first().x == [0, 0, -1]


def test_clashing_columns_and_other_types(spark):
    d = spark.createDataFrame([(i, [i % 3, i % 5], "a", 1, {"k": 1}) for i in range(15)], "vec_id int, embedding array<int>, x string, n long, `a.b` map<string,int>")
    got = W.report(d).collect()
    assert len(got) == 30 and {r.n for r in got} == {15}
