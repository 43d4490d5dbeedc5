import random
from dataclasses import replace

import numpy as np
import pytest

from pathloom.models import distributed as D

TRIPLETS = "profile long, asn long, hop int, weight double"


def case(geometry, seed=1):
    rng, cfg = np.random.default_rng(seed), D.Config(dim=3, heads=2, geometry=geometry, positives=4, negatives=5, sim_weight=0.3, diversity=0.2)
    h, a = rng.normal(0, 0.2, (6, 2, 3)), rng.normal(0, 0.2, (9, 3))
    pos, neg, hop = rng.integers(0, 9, (6, 4)), rng.integers(0, 9, (6, 5)), rng.integers(0, 3, (6, 4))
    return cfg, h, a, (pos, hop, rng.random((6, 4)) + 0.1, neg, rng.random((6, 2, 4)) < 0.3, rng.permutation(6), rng.random(6))


@pytest.mark.parametrize("geometry", ["hyperbolic", "euclidean"])
def test_gradients_are_those_of_the_loss(geometry):
    cfg, h, a, rest = case(geometry)
    _, gh, at, ga = D.block_loss(h, a, *rest, cfg)
    by_a = np.zeros_like(a)
    np.add.at(by_a, at, ga)
    for v, g in ((h, gh), (a, by_a)):
        for _ in range(12):
            i = tuple(np.random.default_rng(_).integers(0, n) for n in v.shape)
            e = np.zeros_like(v)
            e[i] = 1e-6
            up, down = (D.block_loss(*((v + s * e, a) if v is h else (h, v + s * e)), *rest, cfg)[0] for s in (1, -1))
            assert g[i] == pytest.approx((up - down) / 2e-6, abs=2e-4)


def test_geodesics():
    rng = np.random.default_rng(2)
    v, u = rng.normal(0, 0.2, (5, 3)), rng.normal(0, 0.1, (5, 3))
    w = D.move(v, u, "hyperbolic")
    far = D.distance(v, w, "hyperbolic")[0]
    assert np.allclose(far, np.linalg.norm(u, axis=1) * 2 / (1 - (v * v).sum(1)), rtol=1e-3)  # the step's length in the ball's metric
    assert (np.linalg.norm(D.move(v, u * 1e6, "hyperbolic"), axis=1) < 1).all() and np.allclose(D.move(v, u, "euclidean"), v + u)


def test_affinity():
    lo, hi = np.array([0, -1, 3]), np.array([0, 0, 0])
    assert D.affinity(lo, hi, np.array([0, 0, 0])).tolist() == [1.0, 0.0, 1 - 2 / 64]


def triplets(spark, n=60):
    rng = random.Random(3)
    return spark.createDataFrame([(p, a, rng.randint(0, 3), 1.0) for p in range(n) for a in rng.sample(range(100 + (p % 2) * 10, 110 + (p % 2) * 10), 4)], TRIPLETS)


CFG = D.Config(dim=4, epochs=6, rate=0.1, block=16, positives=4, negatives=8)


def test_stopped_training_goes_on_to_the_same_model(spark, tmp_path):
    t = triplets(spark)
    prints = t.select("profile").distinct().selectExpr("profile pid", "profile * 7 lo", "profile hi")
    a, h, losses = D.fit(spark, t, CFG, prints, str(tmp_path / "whole"))
    D.fit(spark, t.repartition(7), CFG, prints, str(tmp_path / "cut"), stop_at=2)
    b, g, again = D.fit(spark, t, CFG, prints, str(tmp_path / "cut"))
    assert losses == again and len(losses) == 6 and losses[-1] < losses[0]  # whole numbers are added up: neither the cut nor the dealing matters
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and sorted(map(str, h.collect())) == sorted(map(str, g.collect()))
    assert a.count() == 20 and h.count() == 60 and {len(r.heads) for r in h.collect()} == {2} and {len(x) for r in h.collect() for x in r.heads} == {4}
    assert {p.name.split("-")[0] for p in (tmp_path / "cut").iterdir()} == {"epochs", "profiles", "networks"} and len(list((tmp_path / "cut").glob("profiles-*"))) <= 2


def test_own_networks_come_nearer_than_others(spark):
    t = triplets(spark, 40)
    a, h, _ = D.fit(spark, t, replace(CFG, geometry="euclidean", epochs=12))
    vec, own = {r.asn: np.array(r.vec) for r in a.collect()}, {}
    for r in t.collect():
        own.setdefault(r.profile, set()).add(r.asn)
    near = lambda p, n: min(np.linalg.norm(np.array(x) - vec[n]) for x in p.heads)
    rows = h.collect()
    assert np.mean([near(p, n) for p in rows for n in own[p.pid]]) < np.mean([near(p, n) for p in rows for n in vec if n not in own[p.pid]])


def test_no_triplets_and_plateau(spark):
    with pytest.raises(ValueError, match="no triplets"):
        D.fit(spark, spark.createDataFrame([], TRIPLETS), CFG)
    _, _, losses = D.fit(spark, triplets(spark, 6), replace(CFG, rate=0.0, epochs=9, stop_after=2, patience=1))
    assert len(losses) < 9  # nothing gets better: it stops early
