import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import bits, geometry, network, text
from pathloom.operators import pairs

M = 1 << 64


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_edge_words_equal_unsigned_arithmetic(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 1, 2**32 - 1, rng.randrange(2**32)]), rng.randrange(2**32)) for _ in range(200)]
    for r in bits.edge_words(spark.createDataFrame(rows, "u long, v long")).collect():
        h1 = (r.u * bits.U1 + r.v * bits.V1) % M
        h2 = ((r.u ^ bits.UX) * bits.UM + (r.v ^ bits.VX) * bits.VM) % M
        assert (r.h1 % M, r.h2 % M) == (h1, h2)


def test_hamming_and_affinity(spark):
    h = bits.hamming(F.lit(-1), F.lit(0), F.lit(0), F.lit(7))
    assert one(spark, h) == 67
    assert [one(spark, bits.recalibrated(F.lit(x))) for x in (0, 32, 64, 128)] == [1.0, 0.5, 0.0, 0.0]


def test_distances_against_numpy(spark):
    rng = np.random.default_rng(2)
    for _ in range(5):
        a, b = rng.normal(size=(2, 24)) * 0.15
        want = np.arccosh(1 + 2 * ((a - b) ** 2).sum() / ((1 - (a**2).sum()) * (1 - (b**2).sum())))
        col = lambda v: F.array(*map(F.lit, v.tolist()))
        assert one(spark, geometry.poincare(col(a), col(b))) == pytest.approx(want)
        assert one(spark, geometry.radius(col(a))) == pytest.approx(2 * np.arctanh(np.linalg.norm(a)))
        assert one(spark, geometry.chamfer(F.array(col(a)), F.array(col(b)))) == pytest.approx(want)
        assert one(spark, geometry.head_spread(F.array(col(a)))) == 0


def test_threshold_scale(spark):
    assert [round(one(spark, geometry.threshold_scale(F.lit(x))), 9) for x in (0.1, 0.8, 0.875, 0.95, 0.99)] == [0.8, 0.8, 0.9, 1.0, 1.0]


@pytest.mark.parametrize("prefix,want", [("10.1.2.128/25", 3), ("10.1.9.0/24", 2), ("10.9.0.0/16", 1), ("11.0.0.0/8", None), ("bad", None), (None, None), ("8.0.0.0/7", 7), ("9.0.0.0/7", 7), ("8.0.0.0/8", None), ("10.1.2.3/24", 3)])
def test_longest_prefix_match(spark, prefix, want):
    table = spark.createDataFrame([("10.0.0.0/8", 1), ("10.1.0.0/16", 2), ("10.1.2.0/24", 3), ("8.0.0.0/7", 7), ("nonsense", 9)], "prefix string, profile_id long")
    got = network.longest_prefix_match(spark.createDataFrame([(prefix,)], "prefix string"), table).collect()
    assert [r.profile_id for r in got] == [want]


def test_longest_prefix_match_replaces_columns_of_its_names(spark):
    q = spark.createDataFrame([("10.1.0.0/16", "old", 5, "x")], "prefix string, matched_len string, profile_id int, k string")
    r = network.longest_prefix_match(q, spark.createDataFrame([("10.0.0.0/8", 1)], "prefix string, profile_id long"))
    assert sorted(r.columns) == ["k", "matched_len", "prefix", "profile_id"] and (r.first().matched_len, r.first().profile_id) == (8, 1)


@pytest.mark.parametrize("prefix,want,length", [("2001:db8:1::/48", 1, 32), ("2001:db8:1:2::5/64", 2, 56), ("2001:0DB8:0001:0200::/56", 4, 48), ("2001:db9::/32", None, None), ("2001::/16", 3, 16), ("2002::/16", None, None), ("::ffff:10.1.2.0/120", None, None), ("10.1.2.0/24", 5, 8), ("2001:zz::/48", None, None)])
def test_longest_prefix_match_of_both_families(spark, prefix, want, length):
    table = spark.createDataFrame([("2001:db8::/32", 1), ("2001:db8:1::/56", 2), ("2001:db8:1::/48", 4), ("2001::/16", 3), ("10.0.0.0/8", 5), ("::", 6), (None, 7)], "prefix string, profile_id long")
    if prefix == "2001:db8:1::/48":
        table = table.where("profile_id <> 4")
    rows = spark.createDataFrame([(prefix, 1), (prefix, 2), (None, 3)], "prefix string, k int")
    got = sorted((r.k, r.profile_id, r.matched_len) for r in network.longest_prefix_match(rows, table).collect())
    assert got == [(1, want, length), (2, want, length), (3, None, None)]


def test_v6_chain_and_canonical(spark):
    d = spark.createDataFrame([("2001:db8:1::1/48",), ("2001:db8::/31",), ("10.1.2.3/24",), ("x",), (None,)], "p string")
    got = d.select(network.canonical("p").alias("c"), network.supernets("p").alias("s")).collect()
    assert got[0].c.prefix == "2001:db8:1::/48" and [x.len for x in got[0].s] == list(range(48, 31, -1))
    assert [x.len for x in got[1].s] == [31] and got[2].c.prefix == "10.1.2.0/24" and len(got[2].s) == 17
    assert got[3].c.prefix is None and got[3].s is None and got[4].s is None


def test_org_names(spark):
    names = {"Foo & Bar Holdings, Inc.": "foo and bar", "LLC Group": None, "  ": None, None: None, "A.B.C. Ltd": "a b c", "Cocoa Co": "cocoa"}
    for raw, want in names.items():
        assert one(spark, text.normalize_org(F.lit(raw).cast("string"))) == want


def test_lists_reasons_paths(spark):
    assert one(spark, text.text_list(F.lit("7::8"))) == [7, 8] and one(spark, text.text_list(F.lit(None).cast("string"))) == []
    assert one(spark, text.has_reason(F.lit("org_id; RPKI valid"), "RPKI")) and not one(spark, text.has_reason(F.lit(None).cast("string"), "RPKI"))
    assert one(spark, text.path_numbers(F.lit("AS10, as20 30"))) == [10, 20, 30]


@pytest.mark.parametrize("name,want", [("rib.ris.20260101.0800.rrc00.gz", ("rib", "ris", "rrc00")), ("upd.rv.20260101.0815.route-views.sg.bz2", ("upd", "rv", "route-views.sg")), ("bview.20260101.0000-03", ("rib", "ris", "03")), ("updates.20260101.0005-21.gz", ("upd", "ris", "21")), ("rib.ris.20260101.0800.rrc00.gz.tmp", None), ("notes.txt", None)])
def test_archive_names(spark, name, want):
    got = one(spark, text.archive_name(F.lit(name)))
    assert (got and (got.type, got.source, got.collector)) == want


def test_tiers(spark):
    assert [one(spark, text.rank_tier(F.lit(r).cast("long"))) for r in (1, 500, 501, 15000, 15001, None, 0, -3)] == ["1-500", "1-500", "501-2000", "5001-15000", ">15000", "Unknown", "Unknown", "Unknown"]


def test_draws_stay_in_range(spark):
    d = spark.range(200).select(F.col("id").alias("pid"))
    got = pairs.negatives(d, 37, 5).agg(F.min("asn"), F.max("asn"), F.countDistinct("asn")).first()
    assert got[0] >= 1 and got[1] <= 37 and got[2] > 30
    p = pairs.partners(d, 200).collect()
    assert sorted(r.other for r in p) == list(range(200)) and all(r.pid != r.other for r in p)
