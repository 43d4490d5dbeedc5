"""The numbers of IPv4 prefixes are what the parsed prefixes give, odd texts included."""

from pyspark.sql import functions as F

from pathloom.functions import network as N


def test_numbers_are_those_of_the_parsed_prefixes(spark):
    texts = ["10.1.2.3/24", "010.1.2.3/8", "255.255.255.255/32", "256.0.0.0/8", "1.2.3.4/33", "1.2.3.4/0", "1.2.3/8", "1.2.3.4", "1.2.3.4/8 ", " 1.2.3.4/8", "::/0", "", None, "0.0.0.0/00", "199.299.1.1/9", "4294967296.1.1.1/8"]
    rows = N._v4_numbers(spark.createDataFrame([(t,) for t in texts], "k string").withColumn("p", N.v4_parse(F.col("k"))), "k", "n").collect()
    assert [r.n for r in rows] == [None if r.p is None else r.p.net * 64 + r.p.len for r in rows] and sum(r.n is not None for r in rows) == 5
