"""Profiles: the least hops of each prefix, shared signatures, triplets, and summaries of their graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .quantiles import ranged


def min_hops(routes: DataFrame) -> DataFrame:
    """(prefix_id, asn, hop, from_rib): hops from the origin; a snapshot's hop wins over an update's even if it is larger."""
    each = routes.where(F.size("path") > 1).select("prefix_id", "source", F.size("path").alias("n"), F.posexplode("path").alias("i", "asn"))
    hop = F.col("n") - 1 - F.col("i")
    rib = F.min(F.when(F.col("source") == "RIB", hop))
    return each.groupBy("prefix_id", "asn").agg(F.coalesce(rib, F.min(hop)).cast("int").alias("hop"), rib.isNotNull().alias("from_rib"))


def signatures(hops: DataFrame) -> DataFrame:
    """(prefix_id, signature): sorted (asn, hop) pairs."""
    return hops.groupBy("prefix_id").agg(F.sort_array(F.collect_list(F.struct("asn", "hop"))).alias("signature"))


def profiles(signed: DataFrame) -> DataFrame:
    """(profile_id, signature, prefixes): one row for each signature, numbered in order of the signatures.

    Numbers come from a range partitioning and per-partition offsets, so no task holds all profiles.
    """
    return number(signed.groupBy("signature").agg(F.count("*").alias("prefixes")), ["signature"], "profile_id")


def number(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense numbers from 0 in the given order of distinct rows, without a global window.

    The ranges' bounds are drawn anew by each job that plans them, so the ranged rows are written once: places in a range and
    the offsets of the ranges then belong to the same rows, also when a task runs again.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    spread = stored(ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1), "numbered")
    sizes = {r["_p"]: r["n"] for r in spread.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row a partition
    offsets, at = [], 0
    for p in sorted(sizes):
        offsets.append((p, at))
        at += sizes[p]
    table = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "_p int, _o long")
    return spread.join(F.broadcast(table), "_p").withColumn(name, F.col("_k") + F.col("_o")).drop("_p", "_k", "_o")


def triplets(hops: DataFrame, members: DataFrame) -> DataFrame:
    """(profile, asn, hop, weight): 1.0 where any of the profile's prefixes has a snapshot route, else 0.2."""
    return hops.join(members, "prefix_id").groupBy("profile", "asn", "hop").agg(F.max(F.when(F.col("from_rib"), 1.0).otherwise(0.2)).cast("double").alias("weight"))


def edges(routes: DataFrame) -> DataFrame:
    """(prefix_id, u, v, depth, n): every occurrence of a link counts; depth is the hop of its far end less one."""
    return routes.where(F.size("path") > 1).select("prefix_id", F.size("path").alias("n"), F.posexplode("path").alias("i", "v"), "path").where("i < n - 1").select(
        "prefix_id", F.get("path", F.col("i") + 1).alias("u"), "v", (F.col("n") - 2 - F.col("i")).cast("int").alias("depth")
    ).groupBy("prefix_id", "u", "v", "depth").agg(F.count("*").alias("n"))


def undirected(links: DataFrame) -> DataFrame:
    return links.where("from_as <> to_as and from_as <> 0 and to_as <> 0").select("prefix_id", F.least("from_as", "to_as").alias("a"), F.greatest("from_as", "to_as").alias("b")).distinct()


def inferred_origins(links: DataFrame) -> DataFrame:
    """(prefix_id, origins): the links' sources that no link leads to, or else the first link's source."""
    g = links.groupBy("prefix_id").agg(F.collect_set("from_as").alias("f"), F.collect_set("to_as").alias("t"), F.min_by("from_as", F.struct("from_as", "to_as")).alias("first"))
    roots = F.array_sort(F.array_except("f", "t"))
    return g.select("prefix_id", F.when(F.size(roots) > 0, roots).otherwise(F.array("first")).alias("origins"))


def neighbors(links: DataFrame) -> DataFrame:
    both = links.select("from_as", "to_as").unionByName(links.select(F.col("to_as").alias("from_as"), F.col("from_as").alias("to_as")))
    return both.where("from_as <> to_as").distinct().groupBy(F.col("from_as").alias("asn")).agg(F.count("*").alias("n_neighbors"), F.min("to_as").alias("least"), F.max("to_as").alias("most"))


def profile_lists(hops: DataFrame, most_hop: int = 5, longest: int = 4096) -> DataFrame:
    """(pid, asn, hop) -> (asn, chunk, pids): the profiles that each network is near to, in order of their ids.

    A network near to most profiles has many: its list goes on in chunks of ``longest``. Places come from ranges of the ids and
    their counts, so no task gets a network's whole list.
    """
    near = hops.where(F.col("hop") < most_hop).select("asn", "pid").distinct()
    rows = stored(ranged(near, "pid", "asn"), "profile-lists")
    per = rows.groupBy("asn", "r").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("asn").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of ranges
    place = F.col("before") + F.row_number().over(Window.partitionBy("asn", "r").orderBy("pid")) - 1
    placed = rows.join(per.select("asn", "r", before.alias("before")), ["asn", "r"]).select("asn", "pid", F.floor(place / longest).alias("chunk"))
    return placed.groupBy("asn", "chunk").agg(F.sort_array(F.collect_list("pid")).alias("pids"))
