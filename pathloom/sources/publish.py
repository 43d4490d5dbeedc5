"""Results that are there whole or not at all: tables of a run under one manifest.

``publish`` writes each table into a folder of the run that no reader looks at by itself, takes length and SHA-256 of every part
(by Spark tasks), and then writes the manifest, one small file, atomically. A run that was killed has no manifest and is written again
over what it left; a run that has one is not written again. ``read`` takes exactly the parts of the manifest, so strays of other
attempts are never read, and refuses parts that are missing or, with ``verify``, changed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the Parquet parts below a folder; one row for each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _manifest(path: str, run: str) -> str:
    return f"{path.rstrip('/')}/manifests/{run}.json"


def published(spark: SparkSession, path: str) -> list[str]:
    """Runs that were finished."""
    return [n.removesuffix(".json") for n in commits.names(spark, f"{path.rstrip('/')}/manifests") if n.endswith(".json")]


def publish(tables: dict[str, DataFrame], path: str, run: str, facts: dict | None = None) -> bool:
    """Writes the tables as one run. False, and nothing written, where the run is there already."""
    spark = next(iter(tables.values())).sparkSession
    if commits.exists(spark, _manifest(path, run)):
        return False
    said = {"run": run, "facts": facts or {}, "tables": {}}
    for name, df in tables.items():
        at = f"{path.rstrip('/')}/runs/{run}/{name}"
        df.write.mode("overwrite").parquet(at)
        said["tables"][name] = {"schema": df.schema.json(), "parts": [r.asDict() for r in _parts(spark, at).orderBy("name").collect()]}  # a short row for each part
    return commits.write_text(spark, _manifest(path, run), json.dumps(said, sort_keys=True))


def manifest(spark: SparkSession, path: str, run: str) -> dict:
    if not commits.exists(spark, _manifest(path, run)):
        raise FileNotFoundError(f"{run} was not finished: {_manifest(path, run)}")
    return json.loads(commits.read_text(spark, _manifest(path, run)))


def read(spark: SparkSession, path: str, run: str, table: str, verify: bool = False) -> DataFrame:
    from pyspark.sql.types import StructType

    said = manifest(spark, path, run)["tables"][table]
    at = f"{path.rstrip('/')}/runs/{run}/{table}"
    wanted = {p["name"]: p for p in said["parts"]}
    there = set(commits.names(spark, at))
    if missing := sorted(set(wanted) - there):
        raise FileNotFoundError(f"{at}: missing parts {', '.join(missing)}")
    if verify and (bad := [s.name for s in states(spark, path, run, table).where("state = 'changed'").collect()]):
        raise ValueError(f"{at}: changed parts {', '.join(sorted(bad))}")
    schema = StructType.fromJson(json.loads(said["schema"]))
    return spark.read.schema(schema).parquet(*(f"{at}/{n}" for n in wanted)) if wanted else spark.createDataFrame([], schema)


def states(spark: SparkSession, path: str, run: str, table: str) -> DataFrame:
    """(name, state): ok, changed, missing, or stray (not in the manifest) of each part."""
    said = manifest(spark, path, run)["tables"][table]["parts"]
    want = spark.createDataFrame([(p["name"], p["bytes"], p["sha256"]) for p in said], "name string, bytes long, sha256 string")
    have = _parts(spark, f"{path.rstrip('/')}/runs/{run}/{table}").select("name", F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("bytes").isNull(), "stray").when((F.col("b") == F.col("bytes")) & (F.col("s") == F.col("sha256")), "ok").otherwise("changed")
    return want.join(have, "name", "full").select("name", state.alias("state"))


def write_done(spark: SparkSession, path: str, slot: str, kind: str, required: dict[str, list[str]], received: dict[str, list[str]], forced: list[str] | None = None) -> bool:
    """The marker of a finished slot with the collectors that are missing, once; see ``readers.read_done_markers``."""
    missing = {s: sorted(set(c) - set(received.get(s, []))) for s, c in required.items()}
    said = {"timestamp": slot, "data_type": kind, "completed_sources": sorted(s for s, m in missing.items() if not m), "required_sources": sorted(required), "forced_sources": sorted(forced or []), "missing_collectors_by_source": missing}
    return commits.write_text(spark, f"{path.rstrip('/')}/{kind}.{slot}.done", json.dumps(said, sort_keys=True))


def reconcile(before: DataFrame, kept: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Whether ``kept`` and ``removed`` part ``before``: (state, n), anything but kept and removed is a fault. Repeats count."""
    tag = lambda d, c: d.groupBy(key).agg(F.count("*").alias(c))
    d = tag(before, "b").join(tag(kept, "k"), key, "full").join(tag(removed, "r"), key, "full").na.fill(0, ["b", "k", "r"])
    state = F.when(F.col("b") == 0, "unknown").when(F.col("k") + F.col("r") < F.col("b"), "lost").when((F.col("k") > 0) & (F.col("r") > 0) | (F.col("k") + F.col("r") > F.col("b")), "twice").when(F.col("k") > 0, "kept").otherwise("removed")
    return d.groupBy(state.alias("state")).agg(F.count("*").alias("n"))
