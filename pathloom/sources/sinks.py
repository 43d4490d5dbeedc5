"""Writers. Spark's commit protocol stands for atomic renames and size headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import list_text


def write_candidates_csv(rows: DataFrame, path: str) -> None:
    """In order of time, flags as 0/1, lists colon-joined."""
    flags = ("is_origin_asn", "is_blackhole_route", "is_ip_leasing")
    out = rows.select(
        F.unix_seconds("ts").alias("timestamp"), "prefix", "asn", "level", "topology_level", "origin",
        *(F.col(c).cast("int").alias(c) for c in flags), *(list_text(F.col(c)).alias(c) for c in ("upstream_asns", "affected_asns")),
    )
    out.orderBy("timestamp", "prefix", "asn").write.mode("overwrite").option("header", True).csv(path)


def write_baseline(links: DataFrame, path: str) -> None:
    """The baseline's links, clustered by prefix so that later anti joins prune row groups."""
    links.repartition("prefix_id").sortWithinPartitions("prefix_id", "from_as", "to_as").write.mode("overwrite").parquet(path)


def write_strict_paths(paths: DataFrame, path: str, longest: int = 255) -> None:
    """Paths of single networks only, no longer than 255."""
    paths.where(F.col("is_strict") & (F.size("path") <= longest)).write.mode("overwrite").parquet(path)


def write_dataset(tables: dict[str, DataFrame], path: str) -> None:
    """Maps, profiles, triplets and fingerprints, a table each."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def write_detections(scored: DataFrame, path: str) -> None:
    """Detections by category and subtype."""
    scored.write.mode("overwrite").partitionBy("category", "subtype").option("header", True).csv(path)


def write_split(rows: DataFrame, reason: str, path: str) -> None:
    """Exempted rows and remaining ones."""
    rows.where(F.col(reason) != "").write.mode("overwrite").option("header", True).csv(f"{path}_false_pos")
    rows.where(F.coalesce(F.col(reason), F.lit("")) == "").drop(reason).write.mode("overwrite").option("header", True).csv(f"{path}_anom")
