"""Evaluation: confusion metrics, misses, recall, comparison of scores, summaries of distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_percentiles

POLICIES = ("archived", "aligned")


def with_policies(m: DataFrame) -> DataFrame:
    """prediction, then the two policies: without matches by organisation id, and also by name."""
    m = m.withColumn("prediction", F.col("geometry") & ~F.col("anchor"))
    return m.withColumn("archived", F.col("prediction") & ~F.col("org_id")).withColumn("aligned", F.col("archived") & ~F.col("org_name"))


def confusion(label: Column, predicted: Column) -> list[Column]:
    y = label == 1
    n = lambda c, name: F.count_if(c).cast("long").alias(name)
    return [n(y & predicted, "tp"), n(y & ~predicted, "fn"), n(~y & predicted, "fp"), n(~y & ~predicted, "tn")]


def rates(d: DataFrame) -> DataFrame:
    """Adds recall, precision, fpr and mcc to counts; null where a denominator is 0."""
    tp, fn, fp, tn = (F.col(c).cast("double") for c in ("tp", "fn", "fp", "tn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return d.withColumns({"recall": F.try_divide(tp, tp + fn), "precision": F.try_divide(tp, tp + fp), "fpr": F.try_divide(fp, fp + tn), "mcc": F.try_divide(tp * tn - fp * fn, root)})


def by_policy(m: DataFrame) -> DataFrame:
    long = m.select("repeat_seed", "label", "missing", F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.col(p).alias("predicted")) for p in POLICIES))).alias("x")).select("repeat_seed", "label", "missing", "x.*")
    return rates(long.groupBy("policy", "repeat_seed").agg(F.count("*").alias("samples"), F.count_if("missing").cast("long").alias("missing"), *confusion(F.col("label"), F.col("predicted"))))


def means(table: DataFrame) -> DataFrame:
    return table.groupBy("policy").agg(*(F.avg(c).alias(c) for c in ("recall", "precision", "fpr", "mcc")))


def first_positives(m: DataFrame) -> DataFrame:
    first = m.agg(F.min("repeat_seed").alias("repeat_seed"))
    return m.where("label = 1").join(F.broadcast(first), "repeat_seed", "left_semi")


def misses(m: DataFrame) -> DataFrame:
    """Attribution of misses, over all scenarios and by scenario in one pass; geometry comes first."""
    g, f, i, n = (F.col(c) for c in ("geometry", "anchor", "org_id", "org_name"))
    org = i | n
    c = lambda cond, name: F.count_if(cond).cast("long").alias(name)
    counts = [
        F.count("*").alias("samples"), c(F.col("missing"), "missing"), c(~g, "geometry_misses"), c(g & f & ~org, "fingerprint_only"), c(g & ~f & i, "org_id_only"), c(g & ~f & n, "org_name_only"),
        c(g & f & org, "both_exemptions"), c(~g & f, "fingerprint_on_negatives"), c(~g & org, "org_on_negatives"), c(g, "detected_geometry"), c(F.col("archived"), "detected_archived"),
        c(F.col("aligned"), "detected_aligned"), c(g & (f | org), "exemption_misses"), c(~F.col("aligned"), "misses_aligned"),
    ]
    return first_positives(m).groupingSets([[], ["scenario"]], "scenario").agg(*counts).withColumn("scenario", F.coalesce("scenario", F.lit("all")))


def check_misses(table: DataFrame) -> None:
    if not table.where("geometry_misses + exemption_misses <> misses_aligned").isEmpty():
        raise ValueError("misses don't add up to the final predictions")


def recall_cells(m: DataFrame, policy: str = "archived") -> DataFrame:
    return first_positives(m).groupBy("scenario", "rank_tier", "depth").agg(F.count("*").alias("samples"), F.count_if(policy).cast("long").alias("detected")).withColumn("recall", F.col("detected") / F.col("samples"))


def compare(actual: DataFrame, expected: DataFrame, key: tuple[str, ...] = ("sample_id", "repeat_seed")) -> DataFrame:
    """One row: rows only on one side, and differences of labels and predictions on both."""
    a = actual.select(*key, F.col("label").alias("la"), F.col("archived").alias("pa"))
    e = expected.select(*key, F.col("label").alias("le"), F.col("archived").alias("pe"))
    j = a.join(e, list(key), "full_outer")
    c = lambda cond, name: F.count_if(cond).cast("long").alias(name)
    return j.agg(c(F.col("la").isNull(), "only_expected"), c(F.col("le").isNull(), "only_actual"), c(F.col("la") != F.col("le"), "label_differs"), c(F.col("pa") != F.col("pe"), "prediction_differs"))


def check_keys(rows: DataFrame, key: tuple[str, ...] = ("sample_id", "repeat_seed")) -> DataFrame:
    """One row: rows with a null in the key, and keys that repeat."""
    nulls = rows.agg(F.count_if(sum((F.col(k).isNull().cast("int") for k in key), F.lit(0)) > 0).cast("long").alias("null_keys"))
    again = rows.groupBy(*key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).cast("long").alias("repeated_keys"))
    return nulls.join(F.broadcast(again))


def distance_summary(d: DataFrame, by: str, value: str = "d") -> DataFrame:
    """Per group: count, mean, deviation and exact percentiles."""
    moments = d.groupBy(F.col(by).alias("_by")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    names = {"median": 0.5, "q1": 0.25, "q3": 0.75, "p90": 0.9, "p95": 0.95}
    q = exact_percentiles(d, value, list(names.values()), by)
    met = moments.join(q, F.col("_by").eqNullSafe(F.col(by)), "left").select(F.col("_by").alias(by), "n", "mean", "std", *(F.get("p", F.lit(i)).alias(c) for i, c in enumerate(names)))
    return met.withColumn("iqr", F.col("q3") - F.col("q1"))
