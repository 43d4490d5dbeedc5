"""A detection run's rows are scored once, whatever the number of its tables."""

from pyspark.sql import functions as F

from pathloom.operators import detection as N


def test_rows_are_scored_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(x):
        seen.add(1)
        return float(x)

    d = spark.range(12).selectExpr("id rec_id", "id % 4 prefix_id", "id % 3 asn", "timestamp_seconds(id) ts", "id % 2 = 0 is_source", "array(id % 3 + 7) upstream").withColumn("dist_pa", score("rec_id"))
    d = d.withColumn("prediction", F.col("dist_pa") > 3).withColumn("missing", F.col("dist_pa") < 2)
    t = N.outputs(d.select("*"))
    assert (t["anomalous_raw"].count(), t["anomalous_aggregated"].count(), t["missing_raw"].count()) == (8, 4, 2)
    assert N.stats(t).count() == 7 and seen.value <= 2 * 12  # once for the filter, once for the row
