import json
import os

import pytest
from pyspark.sql import functions as F

from pathloom.operators import profiles, sampling
from pathloom.sources import publish as U
from pathloom.sources.readers import read_done_markers
from pathloom.streaming.progress import ProgressTable


def test_killed_and_repeated_runs_leave_one_result(spark, tmp_path):
    at, d = str(tmp_path / "out"), spark.range(40).repartition(3)
    with pytest.raises(FileNotFoundError, match="not finished"):
        U.read(spark, at, "r1", "t")
    d.limit(7).write.parquet(f"{at}/runs/r1/t")  # a run that was killed before its manifest
    with pytest.raises(FileNotFoundError):
        U.read(spark, at, "r1", "t")
    assert U.publish({"t": d, "none": d.where("id < 0")}, at, "r1", {"seed": 42}) and not U.publish({"t": d.limit(1)}, at, "r1")
    assert U.published(spark, at) == ["r1"] and U.manifest(spark, at, "r1")["facts"] == {"seed": 42}
    assert sorted(r.id for r in U.read(spark, at, "r1", "t", verify=True).collect()) == list(range(40)) and U.read(spark, at, "r1", "none").dtypes == d.dtypes
    d.limit(3).write.mode("append").parquet(f"{at}/runs/r1/t")  # a stray attempt
    assert U.read(spark, at, "r1", "t").count() == 40 and {r.state for r in U.states(spark, at, "r1", "t").collect()} == {"ok", "stray"}


def test_missing_and_changed_parts_are_refused(spark, tmp_path):
    at = str(tmp_path / "out")
    U.publish({"t": spark.range(40).repartition(3)}, at, "r")
    parts = sorted((tmp_path / "out" / "runs" / "r" / "t").glob("part-*.parquet"))
    data = parts[0].read_bytes()
    parts[0].write_bytes(data[:-9] + b"x" + data[-8:])
    for crc in (tmp_path / "out" / "runs" / "r" / "t").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match=f"changed parts {parts[0].name}"):
        U.read(spark, at, "r", "t", verify=True)
    os.remove(parts[1])
    with pytest.raises(FileNotFoundError, match=f"missing parts {parts[1].name}"):
        U.read(spark, at, "r", "t")
    assert {r.name: r.state for r in U.states(spark, at, "r", "t").collect()}[parts[1].name] == "missing"


def test_done_markers_round_trip(spark, tmp_path):
    at = str(tmp_path / "done")
    assert U.write_done(spark, at, "20260101.0000", "rib", {"ris": ["00", "01"], "rv": ["a"]}, {"ris": ["01"], "rv": ["a"]}, ["ris"])
    assert not U.write_done(spark, at, "20260101.0000", "rib", {}, {})  # once
    said = json.loads((tmp_path / "done" / "rib.20260101.0000.done").read_text())
    assert said["completed_sources"] == ["rv"] and said["forced_sources"] == ["ris"]
    assert [(r.source, r.collector) for r in read_done_markers(spark, at).collect()] == [("ris", "00")]


def test_reconcile_names_faults(spark):
    d = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r.state: r.n for r in U.reconcile(d(1, 2, 3, 4, 4, 5), d(1, 3, 4, 9), d(2, 3, 4), "id").collect()}
    assert got == {"kept": 1, "removed": 1, "twice": 2, "lost": 1, "unknown": 1}  # 4 came twice and is in both


def test_progress_has_a_row_for_each_batch(spark, tmp_path):
    progress = ProgressTable(spark, str(tmp_path / "progress"))
    assert progress.table().collect() == []
    spark.range(30).repartition(3).write.parquet(str(tmp_path / "in"))
    spark.streams.addListener(progress)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).groupBy((F.col("id") % 4).alias("k")).count()
        q = stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(progress)
    rows = progress.table().where("input_rows > 0").orderBy("batch").collect()
    assert sum(r.input_rows for r in rows) == 30 and len({r.batch for r in rows}) == len(rows) == 3
    assert rows[-1].state_rows == 4 and all("addBatch" in r.millis for r in rows)


def test_samples_are_filled(spark):
    rows = spark.createDataFrame([(i, "a" if i < 4 else "b") for i in range(60)], "id long, g string")
    got = sampling.filled(rows, "g", "id", {"a": 10, "b": 5}, 20, rows.where("id in (3, 59)")).collect()
    count = lambda part, g: sum(r.part == part and r.g == g for r in got)
    assert len(got) == len({r.id for r in got}) == 20 and {r.id for r in got if r.part == "forced"} == {3, 59}
    assert (count("stratum", "a"), count("stratum", "b"), count("rest", "b")) == (3, 5, 10)  # a has 3 others only: the rest makes up for it
    assert len(sampling.filled(rows, "g", "id", {"a": 1, "b": 1}, 500).collect()) == 60
    assert len(sampling.filled(rows, "g", "id", {"a": 1, "b": 1}, 1, rows.where("id < 8")).collect()) == 9  # forced and strata stay
    assert {r.pid for r in sampling.background(spark.createDataFrame([(i, i % 3 if i % 2 else None) for i in range(30)], "prefix_id long, pid long"), 30).collect()} == {0, 1, 2}


def test_profile_lists_go_on_in_chunks(spark):
    hops = spark.range(5000).select(F.col("id").alias("pid"), F.lit(7).cast("long").alias("asn"), F.lit(1).alias("hop")).unionByName(spark.createDataFrame([(1, 8, 4), (2, 8, 5), (1, 8, 4)], "pid long, asn long, hop int"))
    got = {(r.asn, r.chunk): r.pids for r in profiles.profile_lists(hops, 5, 2000).collect()}
    assert got[8, 0] == [1] and [x for k in range(3) for x in got[7, k]] == list(range(5000)) and {len(v) for (a, _), v in got.items() if a == 7} == {2000, 1000}
