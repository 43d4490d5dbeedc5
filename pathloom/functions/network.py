"""Prefixes as text and numbers. IPv4 stays in built-in functions; IPv6 text goes through an Arrow function over ``ipaddress``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

V4_FLOOR, V6_FLOOR = 8, 32
_V4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})/(\d{1,2})$"


def v4_parse(text: Column) -> Column:
    """struct(net, len) with host bits cleared; null for what is no IPv4 prefix."""
    part = lambda i: F.regexp_extract(text, _V4, i).try_cast("bigint")
    ok = F.regexp_like(text, F.lit(_V4)) & (part(5) <= 32)
    for i in range(1, 5):
        ok = ok & (part(i) <= 255)
    ip = part(1) * (1 << 24) + part(2) * (1 << 16) + part(3) * (1 << 8) + part(4)
    return F.when(ok, F.struct(v4_mask(ip, part(5)).alias("net"), part(5).cast("int").alias("len")))


def v4_mask(ip: Column, length: Column) -> Column:
    size = F.pow(F.lit(2.0), 32 - length).cast("bigint")
    return ip - F.pmod(ip, size)


def v4_text(net: Column, length: Column | None = None) -> Column:
    octet = lambda k: F.pmod(F.shiftrightunsigned(net, k), F.lit(256)).cast("string")
    ip = F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))
    return ip if length is None else F.concat(ip, F.lit("/"), length.cast("string"))


def v4_supernets(net: Column, length: Column, floor: int = V4_FLOOR) -> Column:
    """The prefix itself first, then each shorter one down to the floor; below the floor only itself."""
    chain = F.when(length > floor, F.sequence(length.cast("int"), F.lit(floor), F.lit(-1))).otherwise(F.array(length.cast("int")))
    return F.transform(chain, lambda n: F.struct(v4_mask(net, n).alias("net"), n.alias("len")))


@F.pandas_udf(T.StructType().add("prefix", T.StringType()).add("family", T.IntegerType()).add("len", T.IntegerType()))
def canonical(text: pd.Series) -> pd.DataFrame:
    """Any prefix with host bits cleared, its family and length; nulls for bad text."""
    import ipaddress

    def one(t):
        try:
            n = ipaddress.ip_network(t, strict=False)
            return str(n), n.version, n.prefixlen
        except (ValueError, TypeError):
            return None, None, None

    out = pd.DataFrame([one(t) for t in text], columns=["prefix", "family", "len"])
    return out.astype({"family": "Int32", "len": "Int32"})


@F.pandas_udf(T.ArrayType(T.StructType().add("prefix", T.StringType()).add("len", T.IntegerType())))
def supernets(text: pd.Series) -> pd.Series:
    """Supernet chain of any prefix, most specific first: v4 to /8, v6 to /32; a shorter prefix gives itself alone."""
    import ipaddress

    def one(t):
        try:
            n = ipaddress.ip_network(t, strict=False)
        except (ValueError, TypeError):
            return None
        floor, out = (V4_FLOOR if n.version == 4 else V6_FLOOR), [{"prefix": str(n), "len": n.prefixlen}]
        while n.prefixlen > floor:
            n = n.supernet()
            out.append({"prefix": str(n), "len": n.prefixlen})
        return out

    return text.map(one)


_OCTET = r"(?:[01]?\d{1,2}|2[0-4]\d|25[0-5])"
_V4_STRICT = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}/(?:[0-2]?\d|3[0-2])$"


def _v4_number(net: Column, length: Column) -> Column:
    """An IPv4 prefix as one number."""
    return net * 64 + length


def _v4_numbers(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the number of each IPv4 prefix, null for what is none, from one match and one split of the text."""
    parts = F.aggregate(F.split(text, "[./]"), F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    raw, length = F.col("_raw"), F.col("_raw").bitwiseAND(F.lit(255))
    rows = rows.withColumn("_raw", F.when(F.regexp_like(text, F.lit(_V4_STRICT)), parts))
    return rows.withColumn(name, _v4_number(v4_mask(F.shiftright(raw, 8), length), length)).drop("_raw")


def _of_lengths(known: DataFrame) -> DataFrame:
    """_lengths of the table's prefixes: one row, of at most 129 numbers."""
    return F.broadcast(known.agg(F.collect_set("len").alias("_lengths")))


def longest_prefix_match(queries: DataFrame, table: DataFrame, key: str = "prefix", value: str = "profile_id") -> DataFrame:
    """Adds ``value`` of the most specific table prefix that covers the query, and matched_len; null where there is none.

    Distinct prefixes fan out to those of their supernets (at most 33 for IPv4, 97 for IPv6) whose length some table prefix has,
    and meet the table by equality: a plain hash join, whatever the table's size. IPv4 stays in built-in functions and moves as
    numbers. Of equal table prefixes the largest value wins. Columns of the queries that are named like the two are replaced.
    IPv4 addresses written as IPv6 are IPv6.
    """
    queries = queries.drop(*(c for c in queries.columns if c.lower() in (value.lower(), "matched_len")))
    v6 = F.contains(F.col(key), F.lit(":"))
    # an IPv4 prefix is its number, what may be IPv6 its text; the Arrow function gives null for bad text
    queries = _v4_numbers(queries, key, "_n")
    rows = table.select(F.col(key).alias("k"), F.col(value).alias("v"))
    known = _v4_numbers(rows, "k", "s").select("s", (F.col("s") % 64).cast("int").alias("len"), "v").where("s is not null")
    net, n = F.shiftright("k", 6), F.col("k").bitwiseAND(F.lit(63)).cast("int")
    chain = queries.select(F.col("_n").alias("k")).distinct().join(_of_lengths(known))
    chain = chain.select("k", F.explode(F.filter("_lengths", lambda x: (x == n) | ((x < n) & (x >= V4_FLOOR)))).alias("len"))
    chain = chain.select("k", "len", _v4_number(v4_mask(net, F.col("len")), F.col("len")).alias("s"))
    met = chain.join(known.select("s", "v"), "s").select(F.col("k").cast("string").alias("k"), "len", "v")
    known6 = rows.where(F.contains("k", F.lit(":"))).select(canonical(F.col("k")).alias("c"), "v").where("c.prefix is not null").select(F.col("c.prefix").alias("p"), "c.len", "v")
    chain6 = queries.where(v6).select(F.col(key).alias("k")).distinct().select("k", supernets(F.col("k")).alias("c"))
    chain6 = chain6.join(_of_lengths(known6)).select("k", F.explode(F.filter("c", lambda x: F.array_contains("_lengths", x["len"]))).alias("s")).select("k", F.col("s.prefix").alias("p"), F.col("s.len").alias("len"))
    met = met.unionByName(chain6.join(known6.select("p", "v"), "p").select("k", "len", "v"))
    best = met.groupBy(F.col("k").alias("_lpm")).agg(F.max(F.struct("len", "v")).alias("b")).select("_lpm", F.col("b.v").alias(value), F.col("b.len").alias("matched_len"))
    queries = queries.withColumn("_lpm", F.coalesce(F.col("_n").cast("string"), F.when(v6, F.col(key)))).drop("_n")
    return queries.join(best, "_lpm", "left").drop("_lpm")
