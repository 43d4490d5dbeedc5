import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathloom.models import embed
from pathloom.operators import calibrate, completeness, evaluate, exempt, graph, grouping, paths, pivots, profiles, sampling, scoring


def routes(spark, rows):
    d = spark.createDataFrame(rows, "prefix_id long, source string, path array<long>")
    return d.withColumn("origin", F.try_element_at("path", F.lit(-1)))


def test_path_functions(spark):
    r = spark.createDataFrame([([10, 10, 20, 30, 30, 20],), ([7],), ([],)], "p array<long>").select(paths.drop_repeats(F.col("p")).alias("path"), paths.path_links(paths.drop_repeats(F.col("p"))).alias("l")).collect()
    assert r[0].path == [10, 20, 30, 20] and [(x.from_as, x.to_as) for x in r[0].l] == [(20, 10), (30, 20), (20, 30)]
    assert r[1].l is None and r[2].path == []
    s = spark.createDataFrame([([[1], [2, 3], [4]],), ([[1], [1], [2]],)], "s array<array<long>>").select(paths.is_strict(F.col("s")).alias("ok"), paths.set_links(F.col("s")).alias("l"), paths.linearize(F.col("s")).alias("p")).collect()
    assert not s[0].ok and sorted(map(tuple, s[0].l)) == [(2, 1), (3, 1), (4, 2), (4, 3)] and s[1].ok and s[1].p == [1, 2] and len(s[1].l) == 1
    assert len(spark.range(1).select(paths.path_links(F.sequence(F.lit(1), F.lit(40)), 27).alias("l")).first().l) == 27


def test_min_hops_and_weights(spark):
    r = routes(spark, [(1, "RIB", [3, 4, 7, 5, 6, 8, 9]), (1, "UPD", [7, 9]), (1, "UPD", [2, 9]), (2, "UPD", [5])])
    h = {(x.prefix_id, x.asn): (x.hop, x.from_rib) for x in profiles.min_hops(r).collect()}
    assert h[1, 7] == (4, True) and h[1, 2] == (1, False) and h[1, 9] == (0, True) and (2, 5) not in h
    loop = {x.asn: x.hop for x in profiles.min_hops(routes(spark, [(1, "RIB", [10, 20, 30, 20])])).collect()}
    assert loop == {10: 3, 20: 0, 30: 1}


def test_dense_numbers(spark):
    d = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 300)], "v long").repartition(5)
    got = {r.v: r.k for r in profiles.number(d, ["v"], "k").collect()}
    assert got == {v: k for k, v in enumerate(sorted(got))}
    assert profiles.number(d.limit(0), ["v"], "k").count() == 0


def test_dense_numbers_of_many_rows(spark):
    """Over a million rows, of a skewed and unsorted column, in many partitions: every number once, in order."""
    n = 1_200_000
    d = spark.range(0, n, 1, 37).select(F.concat(F.when(F.col("id") % 3 == 0, "a").otherwise("b"), F.sha1(F.col("id").cast("string"))).alias("v"))
    got = profiles.number(d, ["v"], "k")
    from pyspark.sql import Window

    assert got.agg(F.count("*"), F.countDistinct("k"), F.min("k"), F.max("k")).first() == (n, n, 0, n - 1)
    block = Window.partitionBy(F.floor(F.col("k") / 10_000)).orderBy("k")
    assert got.withColumn("before", F.lag("v").over(block)).where("before >= v").isEmpty()


def closure(links):
    nodes = {x for e in links for x in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in links:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    return reach


@pytest.mark.parametrize("seed", range(25))
def test_components_and_levels_against_closure(seed):
    rng = random.Random(seed)
    links = [(rng.randint(1, 9), rng.randint(1, 9)) for _ in range(rng.randint(1, 16))]
    g, reach = graph.Condensed(links), closure(links)
    for a in reach:
        for b in reach:
            same = b in reach[a] and a in reach[b]
            assert (g.of[a] == g.of[b]) == same
    for a in reach:
        assert {v for d in g.below(g.of[a]) for v in g.members[d]} == reach[a] - set(g.members[g.of[a]])
    for c in range(g.size):
        assert g.level[c] == 1 + max((g.level[d] for d in g.into[c]), default=0)


def test_diamond():
    links = [(1, 2), (1, 3), (2, 4), (3, 4)]
    g = graph.Condensed(links)
    assert [g.level[g.of[v]] for v in (1, 2, 3, 4)] == [1, 2, 2, 3]
    cover = g.coverage(set(range(g.size)))
    assert [round(cover[g.of[v]], 4) for v in (1, 2, 3, 4)] == [1.0, 0.2087, 0.2087, 2.0]
    rows = graph.critical(links, {(2, 4): (50, 1)})
    # the critical network and its predecessor, whose best neighbour is the critical one
    assert [(r[0], r[1], r[3], r[4], r[5]) for r in rows] == [(2, 50, 2, 2, [4]), (4, 50, 3, 3, [2])]


def test_cycle_is_one_component_and_self_loops_are_harmless():
    rows = graph.critical([(1, 2), (2, 3), (3, 2), (3, 4), (2, 2)], {(2, 3): (9, 1)})
    assert {r[0] for r in rows} <= {2, 3, 4} and all(r[5] == [] for r in rows if r[0] in (2, 3))
    assert graph.critical([], {}) == []


def test_deep_chain_needs_no_recursion():
    assert graph.Condensed([(i, i + 1) for i in range(5000)]).size == 5001


def test_anchors_cover_all(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(-(2**63), 2**63 - 1, (4, 2))
    rows = []
    for i in range(200):
        lo, hi = (int(x) for x in base[i % 4])
        for b in rng.integers(0, 63, 4):
            lo ^= 1 << int(b)
        rows.append((i % 3, lo, hi))
    got = [(r.as_id, r.lo, r.hi) for r in exempt.anchors(spark.createDataFrame(rows, "as_id long, lo long, hi long")).collect()]
    far = lambda a, b: bin((a[1] ^ b[1]) & (2**64 - 1)).count("1") + bin((a[2] ^ b[2]) & (2**64 - 1)).count("1")
    assert all(min(far(r, a) for a in got if a[0] == r[0]) <= 12 for r in rows)


def decided(spark, **over):
    base = {"rec_id": 1, "prefix_id": 1, "pid": 1, "as_id": 1, "origin_id": 2, "is_source": False, "dist_pa": 9.0, "dist_po": 1.0, "dist_ao": 1.0, "norm_as": 0.9, "norm_origin": 0.9} | over
    d = spark.createDataFrame([tuple(base.values())], "rec_id long, prefix_id long, pid long, as_id long, origin_id long, is_source boolean, dist_pa double, dist_po double, dist_ao double, norm_as double, norm_origin double")
    r = scoring.decide(d, 5, 5, 5).first()
    return r.geometry, r.missing


@pytest.mark.parametrize(
    "over,want",
    [
        ({}, (False, False)),
        ({"dist_po": 9.0}, (True, False)),
        ({"dist_pa": 1.0, "dist_po": 9.0}, (False, False)),
        ({"dist_ao": 9.0}, (True, False)),
        ({"is_source": True}, (True, False)),
        ({"is_source": True, "dist_pa": 4.5, "norm_as": 0.7}, (True, False)),
        ({"origin_id": None, "dist_po": None, "dist_ao": None}, (True, False)),
        ({"as_id": None, "dist_pa": None, "dist_ao": None, "dist_po": 9.0}, (True, False)),
        ({"as_id": None, "origin_id": None, "dist_pa": None, "dist_po": None, "dist_ao": None}, (False, True)),
        ({"pid": None, "dist_pa": None, "dist_po": None}, (False, True)),
    ],
)
def test_decisions(spark, over, want):
    assert decided(spark, **over) == want


def test_min_error_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(round(rng.gauss(3, 1), 2), 1) for _ in range(150)] + [(round(rng.gauss(5, 1), 2), 0) for _ in range(90)]
    best = min(((sum(d > t for d, y in rows if y) / 150 + sum(d <= t for d, y in rows if not y) / 90).__round__(12), t) for t in {d for d, _ in rows})
    got = calibrate.min_error(spark.createDataFrame(rows, "d double, label int")).first()
    assert got.threshold == best[1] and got.fnr + got.fpr == pytest.approx(best[0])
    one_class = calibrate.final(spark.createDataFrame([(1.0, 1)], "d double, label int"), 4.0).first()
    assert one_class.threshold == 4.0


def test_metrics_are_null_without_a_denominator(spark):
    d = spark.createDataFrame([(1, True), (1, False)], "label int, p boolean")
    r = evaluate.rates(d.agg(*evaluate.confusion(F.col("label"), F.col("p")))).first()
    assert (r.tp, r.fn, r.recall, r.precision, r.fpr, r.mcc) == (1, 1, 0.5, 1.0, None, None)


def test_misses_add_up(spark):
    rng = random.Random(1)
    rows = [(i, 42 + i % 2, rng.randint(0, 1), rng.choice("ab"), *(rng.random() < 0.4 for _ in range(4)), False) for i in range(300)]
    m = evaluate.with_policies(spark.createDataFrame(rows, "sample_id long, repeat_seed long, label int, scenario string, geometry boolean, anchor boolean, org_id boolean, org_name boolean, missing boolean"))
    evaluate.check_misses(evaluate.misses(m))
    assert evaluate.compare(m, m).first().asDict() == {"only_expected": 0, "only_actual": 0, "label_differs": 0, "prediction_differs": 0}


def test_components_of_networks(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in grouping.components(e).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20, 7: 7}


def test_baseline_as_of(spark):
    t = lambda s: pd.Timestamp(s).to_pydatetime()
    b = spark.createDataFrame([(t("2024-01-01 08:00"),), (t("2024-01-03 00:00"),), (t("2024-01-09"),)], "ts timestamp")
    s = spark.createDataFrame([(t(x),) for x in ("2023-12-30", "2024-01-01 08:00", "2024-01-02 12:00", "2024-01-03 01:00", "2024-01-05", "2024-02-01")], "slot timestamp")
    got = {str(r.slot)[:13]: (str(r.baseline)[:13], r.how) for r in completeness.baseline_for(s, b).collect()}
    assert got == {"2023-12-30 00": ("2024-01-01 08", "ahead"), "2024-01-01 08": ("2024-01-01 08", "back"), "2024-01-02 12": ("2024-01-01 08", "back"), "2024-01-03 01": ("2024-01-03 00", "back"), "2024-01-05 00": ("2024-01-09 00", "ahead"), "2024-02-01 00": ("None", None)}


def test_policy_checks():
    good = {"sources": {"ris": {"collectors": 2, "collector_ids": ["a", "b"]}}, "rules": {"upd": {"ris": "always"}}}
    completeness.check_policy(good)
    for bad in ({"sources": {"ris": {"collectors": 0, "collector_ids": []}}, "rules": {}}, {**good, "rules": {"upd": {"ris": "sometimes"}}}, {**good, "sources": {"ris": {"collectors": 2, "collector_ids": ["a", "a"]}}}):
        with pytest.raises(ValueError):
            completeness.check_policy(bad)


def test_nearest_other(spark):
    e = spark.createDataFrame([(1, [0.0, 0.1]), (2, [0.0, 0.2]), (3, [0.5, 0.0])], "asn long, vec array<double>")
    assert {r.asn: r.nearest for r in pivots.nearest_other(e)[0].collect()} == {1: 2, 2: 1, 3: 1}


def test_training_lowers_the_loss():
    rng = np.random.default_rng(1)
    rows = [(p, a, int(rng.integers(0, 4)), 1.0) for p in range(20) for a in rng.choice(np.arange((p % 2) * 10, (p % 2) * 10 + 10), 4, replace=False)]
    t = pd.DataFrame(rows, columns=["profile", "as_id", "hop", "weight"])
    for geometry in ("hyperbolic", "euclidean"):
        got = embed.train(t, 20, embed.Config(dim=4, epochs=60, geometry=geometry, rate=0.05))
        assert min(got.losses) < 0.7 * got.losses[0]
        if geometry == "hyperbolic":
            assert np.linalg.norm(got.as_vec, axis=-1).max() < 1


def test_gradients_by_differences():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2, 3, 5)) * 0.2
    for geometry in ("hyperbolic", "euclidean"):
        d, ga, gb = embed.distance(a, b, geometry)
        for g, x in ((ga, a), (gb, b)):
            step = np.zeros_like(x)
            step[1, 2] = 1e-6
            up = embed.distance(a + (step if x is a else 0), b + (step if x is b else 0), geometry)[0]
            assert (up[1] - d[1]) / 1e-6 == pytest.approx(g[1, 2], rel=1e-3)
