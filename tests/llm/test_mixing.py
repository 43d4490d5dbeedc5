import random

import pytest
from pyspark.sql import functions as F

from pathloom.llm import mixing


def corpus(spark):
    rng = random.Random(2)
    good, low, toxic = ([f"{k}{i}" for i in range(60)] for k in ("word", "BUY", "vile"))
    rows, labels, domain = [], [], {}
    for i in range(500):
        k = rng.choice([0, 0, 0, 1, 2])
        domain[i] = k
        rows.append((i, " ".join(rng.choice((good, low, toxic)[k] if rng.random() < 0.5 else good) for _ in range(rng.randint(20, 90)))))
        if i % 2:
            labels.append((i, 0 if k == 1 else 1, 1 if k == 2 else 0))
    return spark.createDataFrame([(i, t, "en", "s", len(t), "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, copies string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), domain


def test_expected_totals_match_the_targets(spark):
    docs, labels, domain = corpus(spark)
    got = mixing.mix(docs, labels).collect()
    assert len(got) == len(domain)
    totals = [sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) for d in mixing.DOMAINS]
    for d, t in zip(mixing.DOMAINS, totals, strict=True):
        assert t / sum(totals) == pytest.approx(mixing.TARGETS[d], abs=2e-4)
    assert all(r.rate >= 0 for r in got)
    right = sum(max(range(3), key=lambda k: r[f"p_{mixing.DOMAINS[k]}"]) == domain[r.doc_id] for r in got)
    assert right >= 0.98 * len(got)
    kept = {r.doc_id: r.copies for r in got}
    assert all(kept[i] >= 1 for i, k in domain.items() if k == 0)
    assert sum(kept[i] for i, k in domain.items() if k) < 0.5 * sum(k > 0 for k in domain.values())


def test_rates_are_fitted_without_leaving_zero(spark):
    p = spark.createDataFrame([(i, 10 + i, *([0.9, 0.05, 0.05] if i % 3 == 0 else [0.2, 0.7, 0.1] if i % 3 == 1 else [0.1, 0.1, 0.8])) for i in range(90)], "id long, n_tokens long, p0 double, p1 double, p2 double")
    got = mixing.rates(p, {"good": 0.5, "low": 0.25, "toxic": 0.25}).collect()
    totals = [sum(r.rate * r.n_tokens * r[f"p{k}"] for r in got) for k in range(3)]
    assert min(r.rate for r in got) >= 0 and totals[1] / sum(totals) == pytest.approx(0.25, abs=1e-3)


def test_apply_and_edge_cases(spark):
    docs, labels, _ = corpus(spark)
    out = mixing.apply(docs, spark.createDataFrame([(0, 3), (1, 0), (None, 2)], "doc_id long, copies long"))
    assert out.columns == docs.columns and out.count() == 501 and out.where("doc_id = 0").count() == 3 and out.where("doc_id = 1").count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (None, None), (3, "word1 word2"), (3, "word1 word2")], "doc_id long, text string")
    got = mixing.mix(odd, labels)
    assert got.count() == 4 and {r.doc_id: r.copies for r in got.collect()}[1] == 1
    assert mixing.mix(odd, labels.limit(0)).where("rate <> 1 or copies <> 1").count() == 0
    assert mixing.mix(odd.limit(0), labels).count() == 0


def test_copies_meet_small_rates(spark):
    p = spark.range(20_000).withColumn("rate", F.element_at(F.array(F.lit(0.03), F.lit(2.03), F.lit(1.02), F.lit(0.0)), (F.col("id") % 4 + 1).cast("int")))
    got = p.withColumn("copies", mixing.copies()).groupBy("rate").agg(F.avg("copies").alias("mean")).collect()
    mean = {r.rate: r["mean"] for r in got}
    assert mean[0.03] == pytest.approx(0.03, abs=0.01) and mean[2.03] == pytest.approx(2.03, abs=0.01)
    assert mean[1.02] == pytest.approx(1.02, abs=0.01) and mean[0.0] == 0


def test_clashing_names_are_kept(spark):
    docs = spark.createDataFrame([(1, "a", "i", "j", 5, 6), (2, "b", "i", "j", 5, 6), (3, None, "i", "j", 5, 6)], "doc_id long, text string, key string, n string, copies int, _id int")
    out = mixing.apply(docs, spark.createDataFrame([(1, 2), (2, 0)], "doc_id long, copies long"))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 1, 3] and out.where("key = 'i' and n = 'j' and copies = 5 and _id = 6").count() == 3


def test_words_that_differ_late_are_told_apart(spark):
    rows = [(i, " ".join(["common"] * 3 + [f"international{'isation' if i % 2 else 'ities'}"] * 3)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs = docs.withColumn("text", F.concat("text", F.lit(" "), F.col("doc_id")))  # no copies
    got = mixing.mix(docs, labels).collect()
    assert all((r.p_good > 0.5) == bool(r.doc_id % 2) for r in got)


def test_rates_that_cannot_be_met_are_told(spark):
    p = spark.createDataFrame([(i, 10, 1.0, 0.0, 0.0) for i in range(9)], "id long, n_tokens long, p0 double, p1 double, p2 double")
    with pytest.warns(RuntimeWarning, match="no rates"):
        mixing.rates(p, {"good": 0.5, "low": 0.25, "toxic": 0.25}, most=4)


def brute_rates(rows, wanted, rounds=200_000):
    """Projected gradient in its plainest form: rates, one for each document, by small steps in the tokens' metric."""
    import numpy as np

    t, p = np.array([r[0] for r in rows], float), np.array([r[1:] for r in rows])
    r, step = np.ones(len(t)), 1 / np.linalg.eigvalsh((p * t[:, None]).T @ p).max()
    for _ in range(rounds):
        new = np.maximum(0, r - step * p @ ((r * t) @ p - wanted))
        if np.abs(new - r).max() < 1e-12:
            break
        r = new
    return r


def test_rates_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        a = [rng.random() ** 2 for _ in range(3)]
        rows.append((5 + i, *(x / sum(a) for x in a)))
    p = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, n_tokens long, p0 double, p1 double, p2 double")
    targets = {"good": 0.5, "low": 0.3, "toxic": 0.2}
    good = sum(r[0] * r[1] for r in rows)
    want = brute_rates(rows, [good, good * 0.6, good * 0.4])
    got = {r.id: r.rate for r in mixing.rates(p, targets, close=1e-9).collect()}
    assert all(got[i] == pytest.approx(w, abs=1e-3) for i, w in enumerate(want))
