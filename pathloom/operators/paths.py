"""Paths of networks and the links between them. Links point away from the origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_repeats(path: Column) -> Column:
    """A path without consecutive repeats (prepending)."""
    return F.filter(path, lambda x, i: (i == 0) | (x != F.get(path, i - 1)))


def path_links(path: Column, most: int | None = None) -> Column:
    """Links of a path; ``most`` keeps the first so many only."""
    links = F.when(F.size(path) > 1, F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.struct((i - 1).alias("pos"), F.get(path, i).alias("from_as"), F.get(path, i - 1).alias("to_as"))))
    return F.slice(links, 1, most) if most else links


def explode_links(routes: DataFrame, most: int | None = None) -> DataFrame:
    return routes.withColumn("link", F.explode(path_links(F.col("path"), most))).select("*", "link.from_as", "link.to_as").drop("link")


def linearize(segments: Column) -> Column:
    """Sets flattened in order, consecutive repeats dropped."""
    return drop_repeats(F.flatten(segments))


def is_strict(segments: Column) -> Column:
    """Whether every segment is a single network."""
    return F.forall(segments, lambda s: F.size(s) == 1)


def set_links(segments: Column) -> Column:
    """Links between neighbouring segments; sets fan out. Equal neighbouring segments are one."""
    s = F.filter(segments, lambda x, i: (i == 0) | (x != F.get(segments, i - 1)))
    pair = lambda i: F.flatten(F.transform(F.get(s, i), lambda f: F.transform(F.get(s, i - 1), lambda t: F.struct(f.alias("from_as"), t.alias("to_as")))))
    return F.when(F.size(s) > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.size(s) - 1), pair)))


def is_blackhole(communities: Column) -> Column:
    """The well-known community 65535:666."""
    return F.coalesce(F.array_contains(communities, "65535:666"), F.lit(False))


def distinct_routes(routes: DataFrame) -> DataFrame:
    return routes.select("prefix_id", "path").dropDuplicates()


def updates_not_in_snapshot(routes: DataFrame) -> DataFrame:
    """Distinct (prefix, path) of updates that no snapshot route has."""
    rib = routes.where("source = 'RIB'").select("prefix_id", "path")
    return distinct_routes(routes.where("source = 'UPD'")).join(rib, ["prefix_id", "path"], "left_anti")


def look_back(routes: DataFrame, days: int = 14) -> DataFrame:
    """Routes within ``days`` before the latest snapshot, both ends included."""
    last = routes.where("source = 'RIB'").agg(F.max("ts").alias("last"))
    return routes.join(F.broadcast(last), F.col("ts").between(F.col("last") - F.expr(f"interval {days} days"), F.col("last"))).drop("last")
