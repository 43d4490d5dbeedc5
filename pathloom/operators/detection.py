"""A detection run's tables: categories, one row for each prefix, subtypes, false positives and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import reason_text
from ..storage import stored
from . import exempt, grouping
from .scoring import strongest

SUBTYPES = ("origin", "non_origin")


def subtype(level: Column | None = None, is_source: Column | None = None) -> Column:
    """origin where the network is the origin; rows that have no such flag go by their level, 1 being the origin's."""
    flag = is_source if is_source is not None else F.col("is_source")
    if level is not None:
        flag = F.coalesce(flag, level == 1)
    return F.when(flag, "origin").otherwise("non_origin")


def with_groups(rows: DataFrame, share: float = 0.7) -> DataFrame:
    """Adds group_asn: networks are one group with every upstream that at least ``share`` of their rows have."""
    u = grouping.upstream_share(rows.select("rec_id", "asn", "upstream"), share).select(F.col("asn").alias("a"), F.col("upstream").alias("b"))
    found = grouping.components(u).select(F.col("node").alias("asn"), F.col("component").alias("group_asn"))
    return rows.join(found, "asn", "left").withColumn("group_asn", F.coalesce("group_asn", "asn"))


def outputs(decided: DataFrame, share: float = 0.7) -> dict[str, DataFrame]:
    """decided: rec_id, prefix_id, asn, ts, is_source, dist_pa, missing, prediction, upstream -> the tables anomalous_raw,
    anomalous_aggregated (the strongest row of each prefix, with group_asn) and missing_raw, each with its subtype."""
    d = stored(decided.where(F.col("prediction") | F.col("missing")).withColumn("subtype", subtype()), "detection-decided")  # scored once for all tables
    anomalous = d.where("prediction")
    aggregated = stored(with_groups(strongest(anomalous), share), "detection-aggregated")
    return {"anomalous_raw": anomalous, "anomalous_aggregated": aggregated, "missing_raw": d.where("missing")}


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(category, subtype, n_rows, prefixes, asns): raw, aggregated, and both subtypes of what is aggregated (groups count as one network)."""
    of = lambda d, category, name, asn: d.groupBy(F.lit(category).alias("category"), name.alias("subtype")).agg(F.count("*").alias("n_rows"), F.countDistinct("prefix_id").alias("prefixes"), F.countDistinct(asn).alias("asns"))
    a, m = tables["anomalous_aggregated"], tables["missing_raw"]
    rows = of(tables["anomalous_raw"], "anomalous", F.lit("raw"), "asn").unionByName(of(a, "anomalous", F.lit("aggregated"), "group_asn")).unionByName(of(a, "anomalous", F.col("subtype"), "group_asn"))
    rows = rows.unionByName(of(m, "missing", F.lit("raw"), "asn")).unionByName(of(m, "missing", F.col("subtype"), "asn"))
    names = [("anomalous", "raw"), ("anomalous", "aggregated"), *(("anomalous", s) for s in SUBTYPES), ("missing", "raw"), *(("missing", s) for s in SUBTYPES)]
    every = rows.sparkSession.createDataFrame(names, "category string, subtype string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(rows, ["category", "subtype"], "left").select("category", "subtype", zero("n_rows"), zero("prefixes"), zero("asns"))


def false_positives(rows: DataFrame, info: DataFrame, history: DataFrame, rpki: DataFrame, **how) -> DataFrame:
    """Adds reason (empty: stays): the organisation for all rows; a valid RPKI answer for those of subtype origin only, and only
    these are looked up."""
    d = exempt.org_exempt(rows, info, history)
    asked = exempt.rpki_sampled(d.where("subtype = 'origin'").select("asn", "prefix_id"), rpki, **how)
    valid = asked.where("status = 'valid'").select("asn", "prefix_id", F.lit(True).alias("_valid"))
    d = d.join(valid, ["asn", "prefix_id"], "left")
    ok = (F.col("subtype") == "origin") & F.coalesce("_valid", F.lit(False))
    return d.withColumn("reason", F.coalesce(reason_text(F.col("org_reason"), F.when(ok, "RPKI valid")), F.lit(""))).drop("_valid", "org_reason")


def filter_stats(filtered: DataFrame) -> DataFrame:
    """(category, subtype, ..., reason) -> rows, false positives and what stays, of each category and subtype."""
    stays = F.col("reason") == ""
    return filtered.groupBy("category", "subtype").agg(
        F.count("*").alias("total_rows"), F.count_if(~stays).alias("false_positives"), F.count_if(stays).alias("final_rows"),
        F.countDistinct("asn").alias("unique_asns_total"), F.countDistinct(F.when(stays, F.col("asn"))).alias("unique_asns_final"),
    )


def write_run(tables: dict[str, DataFrame], filtered: DataFrame, path: str) -> None:
    """CSV folders below ``path``: <category>_raw, _origin, _non_origin, each split's _false_pos and _anom, and detection_stats,
    which is that before the exemptions first and then that after them. Lists are colon-joined, rows by falling distance."""
    text = lambda d: d.select(*(F.array_join(F.col(c).cast("array<string>"), ":").alias(c) if kind.startswith("array") else F.col(c) for c, kind in d.dtypes))

    def save(d: DataFrame, name: str) -> None:
        order = [F.col("dist_pa").desc_nulls_last(), "prefix_id", "rec_id"] if "dist_pa" in d.columns else []
        (text(d).orderBy(*order) if order else d).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")

    save(stats(tables), "detection_stats")
    for category, raw, split in (("anomalous", "anomalous_raw", "anomalous_aggregated"), ("missing", "missing_raw", "missing_raw")):
        save(tables[raw].drop("subtype"), f"{category}_raw")
        for s in SUBTYPES:
            save(tables[split].where(F.col("subtype") == s).drop("subtype"), f"{category}_{s}")
            mine = filtered.where((F.col("category") == category) & (F.col("subtype") == s)).drop("category", "subtype")
            save(mine.where("reason <> ''"), f"{category}_{s}_false_pos")
            save(mine.where("reason = ''").drop("reason"), f"{category}_{s}_anom")
    save(filter_stats(filtered), "detection_stats")
