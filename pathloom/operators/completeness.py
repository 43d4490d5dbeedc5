"""Which slots of the archives are complete, which baseline to use, and what may be deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slot_rule

# fixed values: which slots each source fills
RULES = {"upd": {"ris": "minute_mod_5", "rv": "minute_mod_15"}, "rib": {"ris": "hour_mod_8", "rv": "hour_mod_4"}}
KNOWN_RULES = ("always", "never", "minute_mod_5", "minute_mod_15", "hour_mod_4", "hour_mod_8")
#: Days after which things may go.
RETENTION_DAYS = {"upd": 14, "rib": 2, "status_upd": 21, "status_rib": 2, "as_info": 45}


def check_policy(policy: dict) -> None:
    """Refuses sources without collectors, wrong counts, repeated collectors and unknown rules."""
    for name, s in policy["sources"].items():
        ids = s["collector_ids"]
        if not ids or s["collectors"] < 1:
            raise ValueError(f"{name}: no collectors")
        if len(ids) != s["collectors"] or len(set(ids)) != len(ids):
            raise ValueError(f"{name}: {s['collectors']} collectors are stated, {len(set(ids))} different ones listed")
    for kind, rules in policy["rules"].items():
        for name, rule in rules.items():
            if rule not in KNOWN_RULES:
                raise ValueError(f"{kind}/{name}: unknown rule {rule!r}")


def counts(collected: DataFrame, expected: DataFrame, kind: str = "upd", rules: dict | None = None) -> DataFrame:
    """(slot, source, collector) and (source, collector) -> per slot and source: expected, received, missing."""
    rules = (rules or RULES)[kind]
    have = collected.groupBy("slot", "source").agg(F.countDistinct("collector").alias("received"))
    sources = expected.groupBy("source").agg(F.countDistinct("collector").alias("all"))
    grid = collected.select("slot").distinct().crossJoin(F.broadcast(sources))  # as many rows a slot as there are sources
    rule = F.create_map(*(F.lit(x) for kv in rules.items() for x in kv))[F.col("source")]
    out = grid.join(have, ["slot", "source"], "left").withColumn("due", slot_rule(rule, F.col("slot")))
    want, got = F.when(F.col("due"), F.col("all")).otherwise(0), F.coalesce("received", F.lit(0))
    return out.select("slot", "source", "due", want.cast("long").alias("expected"), got.cast("long").alias("received"), F.greatest(want - got, F.lit(0)).cast("long").alias("missing"))


def missing_collectors(collected: DataFrame, expected: DataFrame) -> DataFrame:
    """(slot, source, collector) that are expected and not there, for sources with anything in the slot."""
    seen = collected.select("slot", "source").distinct().join(expected, "source")
    return seen.join(collected, ["slot", "source", "collector"], "left_anti").select("slot", "source", "collector")


def slot_status(counted: DataFrame, start: Column, kind: str = "upd", needed: int = 1) -> DataFrame:
    """Per slot: required and completed sources, whether it is done, and whether an old one is forced (snapshots only)."""
    g = counted.groupBy("slot").agg(
        F.array_sort(F.collect_set(F.when(F.col("due") | (F.col("source") == "ris"), F.col("source")))).alias("required"),
        F.array_sort(F.collect_set(F.when(F.col("received") >= needed, F.col("source")))).alias("completed"),
    )
    done = F.size(F.array_except("required", "completed")) == 0
    forced = ~done & (F.lit(kind == "rib")) & (F.col("slot") < start)
    return g.withColumn("done", done).withColumn("forced", forced)


def baseline_for(slots: DataFrame, baselines: DataFrame, tolerance_hours: int = 36) -> DataFrame:
    """For each slot the latest baseline not after it within the tolerance, else the earliest one not before it.

    An as-of join without pairs: baselines and slots are ranked together by one window for each day-sized part of the time
    axis, and each part gets the last baseline before it and the first after it from a small table of parts.
    """
    from pyspark.sql import Window

    b = baselines.select(F.col("ts").alias("t"), F.lit(0).alias("k"), F.col("ts").alias("b"))
    s = slots.select(F.col("slot").alias("t"), F.lit(1).alias("k"), F.lit(None).cast("timestamp").alias("b")).distinct()
    part = F.floor(F.unix_seconds("t") / 86400).alias("part")
    both = b.unionByName(s).withColumn("part", part)
    per = b.withColumn("part", part).groupBy("part").agg(F.max("t").alias("last"), F.min("t").alias("first")).unionByName(s.select(part).distinct().select("part", F.lit(None).cast("timestamp").alias("last"), F.lit(None).cast("timestamp").alias("first")))
    per = per.groupBy("part").agg(F.max("last").alias("last"), F.min("first").alias("first"))  # one row a day
    parts = Window.orderBy("part")
    per = per.select("part", F.last("last", True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(parts.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    w = Window.partitionBy("part").orderBy("t", "k")
    ranked = both.withColumn("back", F.last("b", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("ahead", F.first("b", True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    out = ranked.where("k = 1").join(F.broadcast(per), "part")
    back = F.coalesce("back", "before")
    back = F.when(F.unix_seconds("t") - F.unix_seconds(back) <= tolerance_hours * 3600, back)
    return out.select(F.col("t").alias("slot"), back.alias("back"), F.coalesce("ahead", "after").alias("ahead")).select("slot", F.coalesce("back", "ahead").alias("baseline"), F.when(F.col("back").isNotNull(), "back").when(F.col("ahead").isNotNull(), "ahead").alias("how"))


def next_baseline(baselines: DataFrame, current: Column) -> DataFrame:
    """The latest ready baseline after the current one, if any."""
    return baselines.where(F.col("ts") > current).agg(F.max("ts").alias("ts"))


def without_baseline(updates: DataFrame, baseline: DataFrame) -> DataFrame:
    """Updates of collectors that the baseline has."""
    return updates.join(baseline.select("collector").distinct(), "collector", "left_semi")


def earliest_snapshot(archives: DataFrame) -> DataFrame:
    """The earliest snapshot of each (source, collector); other files pass."""
    rib = archives.where("type = 'rib'").groupBy("source", "collector").agg(F.min_by(F.struct(*archives.columns), F.struct("ts", "path")).alias("x")).select("x.*")
    return rib.unionByName(archives.where("coalesce(type, '') <> 'rib'"))


def expired(files: DataFrame, now: Column) -> DataFrame:
    """(kind, ts) rows that are past their retention."""
    days = F.create_map(*(F.lit(x) for kv in RETENTION_DAYS.items() for x in kv))[F.col("kind")]
    return files.where(F.unix_seconds("ts") < F.unix_seconds(now) - days * 86400)


def fetch_windows(spark: SparkSession, start: str, end: str, span: str = "7 days", step: str = "20 minutes") -> DataFrame:
    """Sliding windows that end in [start, end]."""
    ends = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"interval {step}"))).alias("to"))
    return ends.select((F.col("to") - F.expr(f"interval {span}")).alias("from"), "to")
