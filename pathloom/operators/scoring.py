"""Scoring of candidates: three distances, scaled thresholds, decision, exemption by anchors, one row for each prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.bits import MATCH_DISTANCE, hamming


def distances(cand: DataFrame, as_emb: DataFrame, profile_emb: DataFrame, distance=G.poincare) -> DataFrame:
    """Adds dist_pa, dist_po, dist_ao and the two norms; null where an id is unknown. Each distinct pair is measured once."""
    a = as_emb.select(F.col("asn").alias("as_id"), F.col("vec").alias("va"))
    o = as_emb.select(F.col("asn").alias("origin_id"), F.col("vec").alias("vo"))
    pairs_pa = cand.where("pid is not null and as_id is not null").select("pid", F.col("as_id").alias("x"))
    pairs_po = cand.where("pid is not null and origin_id is not null").select("pid", F.col("origin_id").alias("x"))
    pairs = pairs_pa.unionByName(pairs_po).distinct()
    vec = as_emb.select(F.col("asn").alias("x"), "vec")
    by_profile = pairs.join(vec, "x").join(profile_emb, "pid").select("pid", "x", G.head_distance(F.col("heads"), F.col("vec"), distance).alias("d"))
    by_origin = cand.where("as_id is not null and origin_id is not null").select("as_id", "origin_id").distinct().join(a, "as_id").join(o, "origin_id")
    by_origin = by_origin.select("as_id", "origin_id", distance(F.col("va"), F.col("vo")).alias("dist_ao"))
    norms = as_emb.select("asn", G.norm(F.col("vec")).alias("n"))
    out = cand.join(by_profile.select("pid", F.col("x").alias("as_id"), F.col("d").alias("dist_pa")), ["pid", "as_id"], "left")
    out = out.join(by_profile.select("pid", F.col("x").alias("origin_id"), F.col("d").alias("dist_po")), ["pid", "origin_id"], "left")
    out = out.join(by_origin, ["as_id", "origin_id"], "left")
    out = out.join(norms.select(F.col("asn").alias("as_id"), F.col("n").alias("norm_as")), "as_id", "left")
    return out.join(norms.select(F.col("asn").alias("origin_id"), F.col("n").alias("norm_origin")), "origin_id", "left")


def decide(d: DataFrame, pa: float, po: float, ao: float) -> DataFrame:
    """Adds factor_as, factor_origin, missing and geometry. Comparisons with unknown distances are false."""
    scale = lambda n: F.when(F.col("is_source") & F.col(n).isNotNull(), G.threshold_scale(F.col(n))).otherwise(1.0)
    d = d.withColumn("factor_as", scale("norm_as")).withColumn("factor_origin", scale("norm_origin"))
    above = lambda c, t, f: F.coalesce(F.col(c) > t * F.col(f), F.lit(False))
    p_a, p_o, a_o = above("dist_pa", pa, "factor_as"), above("dist_po", po, "factor_origin"), above("dist_ao", ao, "factor_as")
    p, a, o = (F.col(c).isNotNull() for c in ("pid", "as_id", "origin_id"))
    full = p & a & o & ((F.col("is_source") & (p_a | p_o)) | (~F.col("is_source") & p_a & (p_o | a_o)))
    return d.withColumn("missing", ~p | (~a & ~o)).withColumn("geometry", full | (p & a & ~o & p_a) | (p & ~a & o & p_o))


def anchor_exempt(scored: DataFrame, prints: DataFrame, anchors: DataFrame, every: bool = False, most: int = MATCH_DISTANCE) -> DataFrame:
    """Adds anchor: some anchor of the network is within ``most`` bits of the profile's fingerprint. Only geometric positives
    are tested, or all rows. Distinct (profile, network) pairs meet the anchors."""
    tested = scored.where(F.lit(every) | F.col("geometry")).where("pid is not null and as_id is not null").select("pid", "as_id").distinct()
    met = tested.join(prints, "pid").join(anchors.select("as_id", F.col("lo").alias("alo"), F.col("hi").alias("ahi")), "as_id")
    near = met.where(hamming(F.col("lo"), F.col("hi"), F.col("alo"), F.col("ahi")) <= most).select("pid", "as_id").distinct().withColumn("anchor", F.lit(True))
    out = scored.join(near, ["pid", "as_id"], "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)) & (F.lit(every) | F.col("geometry")))
    return out.withColumn("prediction", F.col("geometry") & ~F.col("anchor"))


def strongest(scored: DataFrame, by: str = "dist_pa") -> DataFrame:
    """One row for each prefix: the largest distance, nulls last, ties by network and time."""
    w = Window.partitionBy("prefix_id").orderBy(F.col(by).desc_nulls_last(), "asn", "ts", "rec_id")
    return scored.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def category() -> Column:
    return F.when(F.col("missing"), "missing").when(F.col("geometry"), "anomalous").otherwise("normal")


def stats(scored: DataFrame) -> DataFrame:
    """Rows and distinct prefixes and networks of each category and subtype, and their totals, in one pass of grouping sets."""
    c = scored.select(category().alias("category"), F.when(F.col("is_source"), "origin").otherwise("non_origin").alias("subtype"), "prefix_id", "asn")
    return c.groupingSets([["category", "subtype"], ["category"]], "category", "subtype").agg(F.count("*").alias("n_rows"), F.countDistinct("prefix_id").alias("prefixes"), F.countDistinct("asn").alias("asns")).withColumn("subtype", F.coalesce("subtype", F.lit("all")))
