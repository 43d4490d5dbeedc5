"""The queries over all prefixes; those without SQL against brute force."""

import os

import pytest

from pathloom.plans import graphs, routes
from pathloom.plans.registered import ORACLES, QUERIES
from tests.test_queries import DATA

tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_no_slices():
    assert not any(f"prefix_id % {n}" in sql for name in ("coverage_scores", "near_hop_pairs") for sql in [ORACLES[name]] for n in (7, 20, 50))


def brute_levels(links, fresh):
    out = set()
    for p in {x[0] for x in links} | {x[0] for x in fresh}:
        level, edge = {o: 1 for q, o in fresh if q == p}, [o for q, o in fresh if q == p]
        while edge:
            edge.sort(key=level.get)
            u = edge.pop(0)
            for q, a, b in links:
                if q == p and a == u and b not in level:
                    level[b] = level[u] + 1
                    edge.append(b)
        out |= {(p, a, k) for a, k in level.items()}
    return out


def test_levels_go_on_to_the_last_network(spark):
    links = [(3, i, i + 1) for i in range(12)] + [(3, 5, 2), (3, 0, 9), (4, 1, 2), (7, 20, 21)]
    fresh = [(3, 0), (7, 20), (7, 21), (8, 5)]
    got = graphs._semantic(spark.createDataFrame(links, "prefix_id long, from_as long, to_as long"), spark.createDataFrame(fresh, "prefix_id long, origin long"))
    assert {tuple(r) for r in got.collect()} == brute_levels(links, fresh)


@tables
def test_every_prefix_has_levels(spark):
    got = QUERIES["semantic_level"](spark, DATA).select("prefix_id").distinct().count()
    assert got == routes._new(spark, DATA).select("prefix_id").distinct().count() > 0
