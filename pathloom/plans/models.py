"""Queries that train models; their rows are not SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import distributed
from ..operators import profiles as R
from ..operators import simhash as S
from ..sources import fixtures as X
from ..storage import stored
from .registered import query


def _triplets(spark, d):
    h = R.min_hops(X.announcements(spark, d))
    return h.select(F.col("prefix_id").alias("profile"), "asn", "hop", F.when(F.col("from_rib"), 1.0).otherwise(0.2).alias("weight"))


def _prints(spark, d):
    return S.simhash(R.edges(X.announcements(spark, d))).select(F.col("prefix_id").alias("pid"), F.col("fp_lo").alias("lo"), F.col("fp_hi").alias("hi"))


@query()
def train_embeddings(spark, d):
    """Losses of a short run over all profiles, by epoch, with the fingerprints' pull and push."""
    _, _, losses = distributed.fit(spark, stored(_triplets(spark, d), "triplets"), distributed.Config(dim=8, epochs=5), _prints(spark, d))
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "epoch int, loss double")


#: (dim, heads) of the sensitivity runs: the dimension with two heads, and the heads with 24 dimensions.
SWEPT = sorted({(n, 2) for n in (12, 16, 24, 32, 48, 64)} | {(24, k) for k in range(1, 7)})


@query()
def sweep_embeddings(spark, d):
    """Series of whole runs (800 epochs, or until nothing gets better for long) by geometry, dimension and heads."""
    configs = [distributed.Config(dim=n, heads=k, epochs=800, geometry=g) for n, k in SWEPT for g in ("hyperbolic", "euclidean")]
    runs = distributed.sweep(spark, stored(_triplets(spark, d), "triplets"), configs)
    return distributed.summary(runs).select("geometry", "seed", "runs", F.to_json("series").alias("series"))
