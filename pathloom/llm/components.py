"""Connected components by alternating large-star and small-star, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, temporary


def _star(near: DataFrame, kept: DataFrame) -> DataFrame:
    """near, kept: (u, v). Joins each kept neighbour v of u to the least of u and its near neighbours.

    The least neighbours are a table of their own, so both inputs of the join are plain exchanges: a hub with a third of
    all edges is split by adaptive execution, and no node's neighbours are ever gathered.
    """
    least = materialize(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return kept.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of longs -> (node, component): the least node reachable. Nodes without an edge to another are left out."""
    with temporary(edges.sparkSession):
        return _components(edges)


def _components(edges: DataFrame) -> DataFrame:
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        stamp = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if stamp == before:
            now = materialize(now, "components", keep=True)
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = stamp
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_star(both, both.where("v > u")).distinct(), "large")  # u > v in all rows from here
        itself = large.select("u", F.col("u").alias("v"))
        now = materialize(_star(large, large.unionByName(itself)).distinct(), "small")
