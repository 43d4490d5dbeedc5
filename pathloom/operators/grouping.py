"""Groups of networks that share upstreams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def upstream_share(rows: DataFrame, least: float = 0.7) -> DataFrame:
    """(rec_id, asn, upstream array) -> (asn, upstream, share): upstreams on at least that share of a network's rows."""
    n = rows.groupBy("asn").agg(F.count("*").alias("n"))
    each = rows.select("asn", F.explode("upstream").alias("up")).groupBy("asn", "up").agg(F.count("*").alias("k"))
    return each.join(n, "asn").withColumn("share", F.col("k") / F.col("n")).where(F.col("share") >= least).select("asn", F.col("up").alias("upstream"), "share")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the least node that is reachable. Labels spread by joins and jump over each other, until
    none moves."""
    both = _cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("c"))
    before = None
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("m"))
        moved = label.join(near, "node").select("node", F.least("c", "m").alias("c"))
        jump = moved.select(F.col("node").alias("c"), F.col("c").alias("far"))
        label = _cut(moved.join(jump, "c", "left").select("node", F.coalesce("far", "c").alias("c")))
        now = label.agg(F.sum(F.col("c").cast("decimal(38,0)")), F.count("*")).first()  # labels only fall
        if now == before:
            return label.withColumnRenamed("c", "component")
        before = now


def _cut(df: DataFrame) -> DataFrame:
    return stored(df, "labels")
