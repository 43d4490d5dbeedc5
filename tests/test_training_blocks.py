"""Tasks go through many blocks, and hand on each network's gradient once; what isn't trained stays as it is."""

from dataclasses import replace

from pathloom.models import distributed as D
from pathloom.plans import models

from .test_training import CFG, triplets


def test_fingerprints_stay_whole_and_networks_come_once_a_task(spark, tmp_path):
    t = triplets(spark)
    prints = t.select("profile").distinct().selectExpr("profile pid", "profile * 123456789012345679 + 1 lo", "-profile * 98765432109876543 - 1 hi")
    D.fit(spark, t.coalesce(1), CFG, prints, str(tmp_path), stop_at=2)
    made = spark.read.parquet(str(tmp_path / "profiles-1"))
    want = {(r.pid, r.lo, r.hi) for r in prints.collect()}
    assert {(r.pid, r.lo, r.hi) for r in made.where("pid is not null").collect()} == want
    files = len(list((tmp_path / "profiles-1").glob("part-*")))
    sums = made.where("pid is null")
    assert made.where("pid is not null").select("block").distinct().count() == 4 and sums.count() <= 20 * min(files, 4) and sums.select("asn").distinct().count() == 20


def test_runs_of_a_sweep_are_whole(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(models.distributed, "sweep", lambda spark, t, configs: asked.extend(configs) or spark.createDataFrame([("x", 1, 1, 1, 0.0)], "geometry string, dim int, heads int, seed int, best_loss double"))
    monkeypatch.setattr(models, "_triplets", lambda spark, d: triplets(spark, 6))
    models.sweep_embeddings(spark, "")
    assert {c.epochs for c in asked} == {800} and {c.stop_after for c in asked} == {D.Config().stop_after}
    for g in ("hyperbolic", "euclidean"):
        assert {c.dim for c in asked if c.geometry == g and c.heads == 2} == {12, 16, 24, 32, 48, 64} and {c.heads for c in asked if c.geometry == g and c.dim == 24} == set(range(1, 7))


def test_runs_in_one_task_have_the_losses_of_all_executors(spark, monkeypatch):
    t, configs = triplets(spark, 40), [replace(CFG, geometry=g, heads=k, epochs=3) for g in ("hyperbolic", "euclidean") for k in (1, 3)]
    small = sorted(D.sweep(spark, t, configs).collect())
    monkeypatch.setattr(D, "FEW_PROFILES", 0)
    assert small == sorted(D.sweep(spark, t, configs).collect()) and len(small) == 4
