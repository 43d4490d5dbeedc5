"""Blocks of rows are measured by one matrix product; only what its error leaves open is measured pair by pair."""

import numpy as np
import pytest

from pathloom.functions import geometry as G


@pytest.mark.parametrize("distance", [G.poincare, G.euclidean])
@pytest.mark.parametrize("dim", [3, 64])
def test_few_pairs_are_measured_one_by_one(distance, dim, monkeypatch):
    rng = np.random.default_rng(dim)
    a, b = (rng.normal(0, 0.3 / dim**0.5, (n, dim)) for n in (40, 90))
    b[7], b[8], same = b[6], a[3], (np.array([5]), np.array([9]))
    rows, seen = G.ROWS[distance], []
    every, pairs = rows(a, b), rows.pairs
    monkeypatch.setattr(rows, "pairs", lambda x, y: seen.append(len(x)) or pairs(x, y), raising=False)
    for most in (0.0, 0.3, float(every[2, 4]), 1.0, 20.0):
        assert (rows.near(a, b, most) == (every <= most)).all()
    i, j, d = rows.nearest(a, b, same, 1e-6)
    assert (d == every[i, j]).all()
    every[same] = np.inf
    want = set(zip(*np.nonzero(every <= every.min(1, keepdims=True) + 1e-6), strict=True))
    assert want <= set(zip(i, j, strict=True)) and 0 < sum(seen) < 2 * len(a)


def test_rows_outside_of_the_ball_are_measured_as_the_columns_do():
    a, b = np.array([[0.1, 0.2], [1.5, 0.0]]), np.array([[0.0, 0.3], [np.nan, 0.0]])
    rows = G.ROWS[G.poincare]
    assert (rows.near(a, b, 1.0) == (rows(a, b) <= 1.0)).all()
