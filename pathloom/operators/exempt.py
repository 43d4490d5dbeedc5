"""Exemptions: organisations, RPKI samples, and anchors by leader clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import hamming
from ..functions.text import normalize_org
from ..storage import stored
from .quantiles import ranged


def profile_orgs(hops: DataFrame, info: DataFrame, most_hop: int = 5) -> DataFrame:
    """(pid, org_ids, org_names): organisations of the networks that were near a profile."""
    near = hops.where(F.col("hop") < most_hop).join(info.select("asn", "org_id", "org_name"), "asn")
    return near.groupBy(F.col("prefix_id").alias("pid")).agg(F.collect_set("org_id").alias("org_ids"), F.collect_set(normalize_org(F.col("org_name"))).alias("org_names"))


def org_exempt(scored: DataFrame, info: DataFrame, history: DataFrame) -> DataFrame:
    """Adds org_reason: org_id, else org_name, else null."""
    mine = info.select("asn", F.col("org_id").alias("_id"), normalize_org(F.col("org_name")).alias("_name"))
    d = scored.join(mine, "asn", "left").join(history, "pid", "left")
    reason = F.when(F.array_contains("org_ids", F.col("_id")), "org_id").when(F.array_contains("org_names", F.col("_name")), "org_name")
    return d.withColumn("org_reason", reason).drop("_id", "_name", "org_ids", "org_names")


def rpki_sampled(queries: DataFrame, status: DataFrame, threshold: int = 20, sample: int = 10, share: float = 0.8) -> DataFrame:
    """(asn, prefix_id) queries and (asn, prefix_id, status) answers -> the status used for each query.

    Networks with over ``threshold`` queries have ``sample`` of them asked, chosen by an arithmetic hash; if ``share`` of the
    answers are valid, the others are taken as valid, else they stay unknown.
    """
    q = queries.distinct()
    n = q.groupBy("asn").agg(F.count("*").alias("n"))
    order = Window.partitionBy("asn").orderBy((F.col("prefix_id") * 1103515245 + F.col("asn") * 12345) % 2147483647, "prefix_id")
    q = q.join(n, "asn").withColumn("asked", (F.col("n") <= threshold) | (F.row_number().over(order) <= sample))
    answered = q.join(status, ["asn", "prefix_id"], "left")
    good = answered.where(F.col("asked") & (F.col("n") > threshold)).groupBy("asn").agg((F.avg(F.when(F.col("status") == "valid", 1.0).otherwise(0.0)) >= share).alias("good"))
    used = F.when(F.col("asked"), F.col("status")).when(F.coalesce("good", F.lit(False)), "valid").otherwise("unknown")
    return answered.join(good, "asn", "left").select("asn", "prefix_id", "asked", used.alias("status"))


def word_parts(lo: Column, hi: Column, parts: int) -> Column:
    """The 128 bits cut into so many parts, each as (number, bits): prints that differ in fewer bits have one in common."""
    first = (parts + 1) // 2
    out = []
    for word, n, at in ((lo, first, 0), (hi, parts - first, first)):
        edges = [64 * k // n for k in range(n + 1)] if n else []
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            bits = F.shiftrightunsigned(word, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) if b - a < 64 else word
            out.append(F.struct(F.lit(at + k).alias("part"), bits.alias("bits")))
    return F.array(*out)


#: Beyond so many parts they are too short to tell prints apart.
MOST_PARTS = 24


def anchors(prints: DataFrame, radius: int = 12, most: int = 2000, block: int = 2000) -> DataFrame:
    """(as_id, lo, hi) fingerprints -> anchors: leaders such that every fingerprint of a network is within ``radius`` of one
    (or the first ``most`` leaders). Fingerprints are taken in their own order, repeats once.

    A round takes about the first ``block`` fingerprints of each network that no leader covers yet, finds the leaders among
    them one after another, and then all that these cover are dropped: what is covered later can lead nothing. So the leaders
    are those of the whole order, but no task gets more of a network than a block (ranges between quantiles, found once).
    Covered fingerprints are found by multi-index hashing: of radius + 1 parts of the bits one must be equal.
    """

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        words = pdf[["lo", "hi"]].sort_values(["lo", "hi"]).to_numpy(np.int64).view(np.uint64)
        chosen, n = np.empty((min(len(words), most), 2), np.uint64), 0
        for w in words:
            if n and np.bitwise_count(chosen[:n] ^ w).sum(axis=1).min() <= radius:
                continue
            if n == len(chosen):
                break
            chosen[n] = w
            n += 1
        return pd.DataFrame({"as_id": pdf["as_id"].iloc[0], "lo": chosen[:n, 0].view(np.int64), "hi": chosen[:n, 1].view(np.int64)})

    shape, key = "as_id long, lo long, hi long", ["as_id", "r"]
    rest = stored(ranged(prints.select("as_id", "lo", "hi").where("as_id is not null").distinct(), "lo", "as_id"), "anchor-prints")
    found = prints.sparkSession.createDataFrame([], shape)
    while not rest.isEmpty():
        per = rest.groupBy(*key).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("as_id").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of ranges
        now = stored(per.withColumn("before", before).where(F.col("before") < block).select(*key), "anchor-block")
        new = stored(rest.join(now, key).groupBy("as_id").applyInPandas(lead, shape), "anchor-leaders")
        found = stored(found.unionByName(new), "anchors")
        full = found.groupBy("as_id").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("as_id")
        left = rest.join(now, key, "left_anti").join(full, "as_id", "left_anti")
        near = hamming(F.col("lo"), F.col("hi"), F.col("alo"), F.col("ahi")) <= radius
        leaders = new.select("as_id", F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
        if radius < MOST_PARTS:
            each = lambda d, lo, hi: d.withColumn("x", F.explode(word_parts(F.col(lo), F.col(hi), radius + 1))).select(*d.columns, "x.part", "x.bits")
            met = each(left, "lo", "hi").join(each(leaders, "alo", "ahi"), ["as_id", "part", "bits"])
        else:
            met = left.join(leaders, "as_id")
        covered = stored(met.where(near).select("as_id", "lo", "hi").distinct(), "anchor-covered")
        rest = stored(left.join(covered, ["as_id", "lo", "hi"], "left_anti"), "anchor-rest")
    order = Window.partitionBy("as_id").orderBy("lo", "hi")  # of leaders: ``most`` and a block at most
    return found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).select("as_id", "lo", "hi")
