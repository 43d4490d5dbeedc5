"""Readers. Each gives a DataFrame with an explicit schema, so filters and columns are pushed into the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import archive_name, text_list


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """Route records from Parquet."""
    return spark.read.schema(schemas.ROUTE_RECORD).parquet(path)


def stream_routes(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """The same as a stream; late rows are known by ``ts``, which a record without one takes from its file's name."""
    rows = spark.readStream.schema(schemas.ROUTE_RECORD).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    named = archive_name(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return rows.withColumn("ts", F.coalesce(F.when(F.col("ts") > F.timestamp_seconds(F.lit(0)), F.col("ts")), named["ts"]))


def rib_records(routes: DataFrame) -> DataFrame:
    """Usable snapshot rows: from a snapshot, with an origin and at least one link."""
    return routes.where((F.col("source") == "RIB") & F.col("origin_asn").isNotNull() & (F.size("as_path") > 1))


def update_records(routes: DataFrame) -> DataFrame:
    """Announcements among updates."""
    return routes.where((F.col("source") == "UPD") & (F.col("event") == "A"))


def read_candidates_csv(spark: SparkSession, path: str) -> DataFrame:
    """The candidate file; missing flag columns read as 0, bad numbers as null, lists as arrays."""
    raw = spark.read.schema(schemas.CANDIDATES_CSV).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").csv(path)
    return with_defaults(raw).select(
        F.timestamp_seconds("timestamp").alias("ts"), "prefix", "asn", "level", "topology_level", "origin",
        *(F.col(c).cast("boolean").alias(c) for c in ("is_origin_asn", "is_blackhole_route", "is_ip_leasing")),
        *(text_list(F.col(c)).alias(c) for c in ("upstream_asns", "affected_asns")),
    )


REQUIRED = ("prefix", "asn", "origin")


def with_defaults(df: DataFrame) -> DataFrame:
    """Refuses a table without the required columns, adds flag columns that are missing and replaces nulls in them."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for c in ("is_blackhole_route", "is_ip_leasing"):
        df = df.withColumn(c, lenient(F.col(c), 0).cast("int") if c in df.columns else F.lit(0))
    return df


def lenient(c: Column, default: int) -> Column:
    return F.coalesce(c.cast("string").try_cast("bigint"), F.lit(default))


def read_as_info(spark: SparkSession, path: str) -> DataFrame:
    """Network descriptions, one JSON object a line; bad lines are dropped."""
    d = spark.read.schema(schemas.AS_INFO).option("mode", "DROPMALFORMED").json(path)
    return d.withColumn("asn", F.col("asn").try_cast("bigint")).where("asn is not null")


def read_latest_as_info(spark: SparkSession, path: str) -> DataFrame:
    """Of files named ``as_info.YYMM*`` only those of the latest month."""
    d = spark.read.schema(schemas.AS_INFO).option("mode", "DROPMALFORMED").json(path)
    month = F.regexp_extract(F.col("_metadata.file_path"), r"as_info\.(\d{4})", 1)
    d = d.withColumn("month", month)
    latest = d.agg(F.max("month").alias("month"))
    return d.join(F.broadcast(latest), "month").withColumn("asn", F.col("asn").try_cast("bigint")).where("asn is not null")


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder as (path, length, type, source, ts, collector); names that are no archives go."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.withColumn("a", archive_name(F.element_at(F.split("path", "/"), -1))).where("a is not null").select("path", "length", "a.*")


def read_done_markers(spark: SparkSession, path: str) -> DataFrame:
    """Missing collectors of finished slots, out of the marker files."""
    d = spark.read.schema(schemas.DONE_MARKER).option("multiLine", True).json(path)
    return d.select("timestamp", "data_type", F.explode("missing_collectors_by_source").alias("source", "collectors")).select("timestamp", "data_type", "source", F.explode("collectors").alias("collector"))


def finished_runs(spark: SparkSession, path: str) -> DataFrame:
    """Manifests of finished runs under a folder."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").option("multiLine", True).schema("status string, geometry string, dimension int, k int, seed int").json(path)
    return d.where("status = 'complete'").withColumn("path", F.col("_metadata.file_path"))


def in_window(rows: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    """start <= ts < end."""
    return rows.where((F.col(ts) >= start) & (F.col(ts) < end))


def window_tasks(archives: DataFrame, start: Column, end: Column) -> DataFrame:
    """Fetch tasks of a window, in time order, with their normalised names."""
    named = F.format_string("%s.%s.%s.%s", "type", "source", F.date_format("ts", "yyyyMMdd.HHmm"), "collector")
    return in_window(archives, start, end).withColumn("dest", named).dropDuplicates(["dest"]).orderBy("ts", "dest")
