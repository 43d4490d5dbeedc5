import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import calibration, copies, detection, pairs

TRIPLETS = "pid long, asn long, hop int, weight double"


def draw(key, i, n):
    return (((key % 1000003) * pairs.A + (i + 1) * (pairs.C * 7919)) % 2147483647) % n


def model(n_profiles, n_as):
    rng = random.Random(7)
    vec = lambda: [rng.uniform(-0.4, 0.4) for _ in range(3)]
    return {p: [vec(), vec()] for p in range(n_profiles)}, {a: vec() for a in range(1, n_as + 1)}


def poincare(a, b):
    a, b = np.array(a), np.array(b)
    return round(float(np.arccosh(max(1.0, 1 + 2 * ((a - b) @ (a - b)) / ((1 - a @ a) * (1 - b @ b))))), 9)


def brute(right, wrong):
    high, low = np.percentile(right, 99.95), np.percentile(wrong, 1.6)
    err = min((sum(x > t for x in right) * len(wrong) + sum(x <= t for x in wrong) * len(right), t) for t in {*right, *wrong})[1]
    return len(right), len(wrong), high, low, err, min(low, max(high, err))


def test_three_thresholds_equal_brute_force(spark):
    rng, (heads, vec) = random.Random(8), model(12, 40)
    rows = [(p, a, rng.randint(0, 9), rng.choice([1.0, 1.0, 1.0000001, 0.2])) for p in range(12) for a in rng.sample(range(1, 41), 9)]
    p = spark.createDataFrame(list(heads.items()), "pid long, heads array<array<double>>")
    e = spark.createDataFrame(list(vec.items()), "asn long, vec array<double>")
    got = {r.kind: tuple(r)[1:] for r in calibration.thresholds(spark.createDataFrame(rows, TRIPLETS), p, e).collect()}
    rib = [(a, b, h) for a, b, h, w in rows if w > 0.9]
    to_head = lambda a, b: min(poincare(h, vec[b]) for h in heads[a])
    near = [(a, b) for a, b, h in rib if h < 8]
    wrong = [to_head(draw(a * 1009 + b, 0, 12), draw(a * 1009 + b, 1, 40) + 1) for a, b in near]
    origins = {a: [b for x, b, h in rib if x == a and h == 0] for a, _, _ in rib}
    origins = {a: o for a, o in origins.items() if o}
    nearest = lambda a, b: min(poincare(vec[b], vec[o]) for o in origins[a])
    known = {a: {b for x, b, _ in rib if x == a} for a in origins}
    others = [nearest(a, b) for a in origins for b in [x for x in (draw(a, i, 40) + 1 for i in range(125)) if x not in known[a]][:25]]
    assert others and len(others) == 25 * len(origins)
    want = {"pa": brute([to_head(*x) for x in near], wrong), "po": brute([to_head(a, b) for a, b, h in rib if h == 0], wrong), "ao": brute([nearest(a, b) for a in origins for b in known[a]], others)}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-8) for k in want)


def test_calibration_without_rows(spark):
    heads, vec = model(3, 5)
    p = spark.createDataFrame(list(heads.items()), "pid long, heads array<array<double>>")
    e = spark.createDataFrame(list(vec.items()), "asn long, vec array<double>")
    with pytest.raises(ValueError, match="weight 1"):
        calibration.thresholds(spark.createDataFrame([(0, 1, 0, 0.2)], TRIPLETS), p, e)
    got = {r.kind: r for r in calibration.thresholds(spark.createDataFrame([(0, 1, 3, 1.0), (1, 2, 4, 1.0)], TRIPLETS), p, e).collect()}
    assert got["po"].threshold == 4.0 and got["po"].n_pos == 0 and got["ao"].threshold is None and got["pa"].threshold is not None


DECIDED = "rec_id long, prefix_id long, pid long, asn long, ts long, is_source boolean, dist_pa double, missing boolean, prediction boolean, upstream array<long>"


def run(spark):
    rows = [
        (1, 1, 1, 10, 1, False, 5.0, False, True, [20, 30]), (2, 1, 1, 11, 2, True, 6.0, False, True, [20]), (3, 2, 2, 10, 3, True, 4.0, False, True, [20]), (4, 3, 3, 12, 4, True, None, False, True, []),
        (5, 4, 4, 20, 5, False, 3.0, False, True, []), (6, 5, 5, 10, 6, True, 9.0, False, False, [1]), (7, 6, None, 10, 7, True, None, True, False, [1]), (8, 7, None, 13, 8, False, None, True, False, []),
    ]
    return detection.outputs(spark.createDataFrame(rows, DECIDED))


def test_outputs_groups_and_stats(spark):
    tables = run(spark)
    # prefix 1's strongest row is 2; 10 and 11 have 20 as upstream on all their rows
    assert {r.rec_id: r.group_asn for r in tables["anomalous_aggregated"].collect()} == {2: 10, 3: 10, 4: 12, 5: 10}
    got = {(r.category, r.subtype): (r.n_rows, r.prefixes, r.asns) for r in detection.stats(tables).collect()}
    assert got == {
        ("anomalous", "raw"): (5, 4, 4), ("anomalous", "aggregated"): (4, 4, 2), ("anomalous", "origin"): (3, 3, 2), ("anomalous", "non_origin"): (1, 1, 1),
        ("missing", "raw"): (2, 2, 2), ("missing", "origin"): (1, 1, 1), ("missing", "non_origin"): (1, 1, 1),
    }


def test_rpki_is_for_origins_only_and_files_are_split(spark, tmp_path):
    tables = run(spark)
    info = spark.createDataFrame([(12, 7, "Twelve Inc"), (99, 7, "Other")], "asn long, org_id long, org_name string")
    history = spark.createDataFrame([(3, [7], [])], "pid long, org_ids array<long>, org_names array<string>")
    answers = spark.createDataFrame([(a, p, "valid") for a, p in ((10, 2), (20, 4), (13, 7))], "asn long, prefix_id long, status string")
    out = None
    for category, name in (("anomalous", "anomalous_aggregated"), ("missing", "missing_raw")):
        rows = tables[name].select(F.lit(category).alias("category"), "subtype", "rec_id", "prefix_id", "pid", "asn", "dist_pa", "upstream")
        d = detection.false_positives(rows, info, history, answers)
        out = d if out is None else out.unionByName(d)
    assert {r.rec_id: r.reason for r in out.collect()} == {2: "", 3: "RPKI valid", 4: "org_id", 5: "", 7: "", 8: ""}  # 5 and 8 are no origins
    at = str(tmp_path / "run")
    detection.write_run(tables, out, at)
    names = {f"{c}_{x}" for c in ("anomalous", "missing") for x in ("raw", "origin", "non_origin", "origin_false_pos", "origin_anom", "non_origin_false_pos", "non_origin_anom")}
    assert set(os.listdir(at)) == names | {"detection_stats"}
    read = lambda n: spark.read.option("header", True).csv(f"{at}/{n}")
    assert sorted(r.rec_id for r in read("anomalous_origin_false_pos").collect()) == ["3", "4"] and [r.rec_id for r in read("anomalous_origin_anom").collect()] == ["2"]
    assert {r.upstream for r in read("anomalous_raw").collect()} >= {"20:30", "20"}
    stats = {(r.category, r.subtype): (r.total_rows, r.false_positives, r.final_rows) for r in read("detection_stats").collect()}
    assert stats == {("anomalous", "origin"): ("3", "2", "1"), ("anomalous", "non_origin"): ("1", "0", "1"), ("missing", "origin"): ("1", "0", "1"), ("missing", "non_origin"): ("1", "0", "1")}


def test_subtype_by_level(spark):
    d = spark.createDataFrame([(None, 1), (None, 2), (True, 3), (False, 1)], "is_source boolean, level int")
    assert [r[0] for r in d.select(detection.subtype(F.col("level"))).collect()] == ["origin", "non_origin", "origin", "non_origin"]


def test_thresholds_of_few_classes_move_no_pairs(spark, monkeypatch):
    rng, (heads, vec) = random.Random(9), model(12, 40)
    rows = [(p, a, rng.randint(0, 9), 1.0) for p in range(12) for a in rng.sample(range(1, 45), 9)]  # some networks have no vector
    given = spark.createDataFrame(rows, TRIPLETS), spark.createDataFrame(list(heads.items()), "pid long, heads array<array<double>>"), spark.createDataFrame(list(vec.items()), "asn long, vec array<double>")
    measured, seen = calibration.measured, []
    monkeypatch.setattr(calibration, "measured", lambda *args, **columns: seen.append(args) or measured(*args, **columns))
    monkeypatch.setattr(calibration, "ROWS", 5, raising=False)
    few = sorted(calibration.thresholds(*given).collect())
    assert not seen and len(few) == 3
    monkeypatch.setattr(copies, "FEW_CELLS", 0)
    many = sorted(calibration.thresholds(*given).collect())
    assert seen and [r[:3] for r in few] == [r[:3] for r in many] and np.allclose([r[3:] for r in few], [r[3:] for r in many], atol=1e-8)
