"""Link state and new links against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINK = ["prefix_id", "from_as", "to_as"]


def latest_state(links: DataFrame) -> DataFrame:
    """Per link and prefix the latest time with its origin (of equal times the least origin)."""
    best = F.max(F.struct("ts", (-F.col("origin")).alias("o")))
    return links.groupBy(*LINK).agg(best.alias("b")).select(*LINK, F.col("b.ts").alias("ts"), (-F.col("b.o")).alias("origin"))


def new_links(updates: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows of updates whose (prefix, link) the baseline hasn't. Both sides meet by hash of the whole key; the baseline's
    repeats are merged before its shuffle."""
    return updates.join(baseline.select(*LINK).distinct(), LINK, "left_anti")


def earliest_trigger(links: DataFrame) -> DataFrame:
    """Per (prefix, link) the first time it was seen, with its origin, and how often."""
    first = F.min(F.struct("ts", "origin"))
    return links.groupBy(*LINK).agg(first.alias("f"), F.count("*").alias("seen")).select(*LINK, F.col("f.ts").alias("ts"), F.col("f.origin").alias("origin"), "seen")


def interval_flags(routes: DataFrame, width: str) -> DataFrame:
    """Blackhole tags of each prefix and interval."""
    return routes.groupBy("prefix_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("routes"), F.max(F.col("is_blackhole").cast("int")).alias("blackhole")).select("prefix_id", F.col("w.start").alias("start"), "routes", "blackhole")


def absorb(baseline: DataFrame, updates: DataFrame, start, hours: int = 8) -> DataFrame:
    """The baseline with the warm-up, the updates of the hours before ``start``, which trigger nothing."""
    warm = updates.where((F.col("ts") >= start - F.expr(f"interval {hours} hours")) & (F.col("ts") < start))
    return baseline.select(*LINK).unionByName(warm.select(*LINK)).distinct()


def history(links: DataFrame, ttl: int = 2 * 3600) -> DataFrame:
    """(prefix_id, rec_id, ts, from_as, to_as) -> per record the number of links that its prefix's history then holds.

    Each record adds its links and renews the history, which is forgotten when more than ``ttl`` seconds pass without one. So
    the times of a prefix fall into lives without such a gap; a link counts from its first time in a life on. Records of one
    time see each other's links. Only counts are summed: no list of links is made, however many a prefix has.
    """
    rows = links.select("prefix_id", "rec_id", F.unix_seconds("ts").alias("s"), "from_as", "to_as")
    order = Window.partitionBy("prefix_id").orderBy("s")
    times = rows.select("prefix_id", "s").distinct().withColumn("gap", F.coalesce((F.col("s") - F.lag("s").over(order) > ttl).cast("int"), F.lit(0)))
    times = times.select("prefix_id", "s", F.sum("gap").over(order).alias("life"))
    first = rows.join(times, ["prefix_id", "s"]).groupBy("prefix_id", "life", "from_as", "to_as").agg(F.min("s").alias("s"))
    added = first.groupBy("prefix_id", "life", "s").agg(F.count("*").alias("n"))
    held = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("prefix_id", "life").orderBy("s"))
    counts = times.join(added, ["prefix_id", "life", "s"], "left").select("prefix_id", "s", held.alias("history"))
    return rows.select("prefix_id", "rec_id", "s").distinct().join(counts, ["prefix_id", "s"]).select("prefix_id", "rec_id", "history")
