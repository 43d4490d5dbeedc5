import json

import pytest
from pyspark.sql import functions as F

from pathloom import schemas
from pathloom.sources import readers, sinks


def test_candidate_file_round_trip(spark, tmp_path):
    rows = [(f"10.0.{i}.0/24", 5, 1, 2, 7, bool(i % 2), False, True, [1, 2] if i else [], [3]) for i in range(3)]
    d = spark.createDataFrame(rows, "prefix string, asn long, level int, topology_level int, origin long, is_origin_asn boolean, is_blackhole_route boolean, is_ip_leasing boolean, upstream_asns array<long>, affected_asns array<long>")
    d = d.select(F.timestamp_seconds(F.lit(100)).alias("ts"), "*")
    sinks.write_candidates_csv(d, str(tmp_path / "c"))
    got = readers.read_candidates_csv(spark, str(tmp_path / "c"))
    assert got.schema.simpleString().replace("struct<", "").rstrip(">") and sorted(got.collect(), key=str) == sorted(d.collect(), key=str)
    assert spark.createDataFrame([], schemas.CANDIDATES).columns == got.columns


def test_required_columns_and_defaults(spark):
    with pytest.raises(ValueError, match="origin"):
        readers.with_defaults(spark.createDataFrame([("p", 1)], "prefix string, asn long"))
    r = readers.with_defaults(spark.createDataFrame([("p", 1, 2, "x")], "prefix string, asn long, origin long, is_ip_leasing string")).first()
    assert (r.is_blackhole_route, r.is_ip_leasing) == (0, 0)


def test_as_info_drops_bad_lines_and_takes_the_latest_month(spark, tmp_path):
    line = lambda n: json.dumps({"asn": str(n), "rank": n, "organization": {"orgId": "o", "orgName": "O"}})
    (tmp_path / "as_info.2501.jsonl").write_text(line(1) + "\n{bad\n" + line(2) + "\n")
    (tmp_path / "as_info.2502.jsonl").write_text(line(3) + "\n")
    assert sorted(r.asn for r in readers.read_as_info(spark, str(tmp_path)).collect()) == [1, 2, 3]
    assert [(r.asn, r.organization.orgName) for r in readers.read_latest_as_info(spark, str(tmp_path)).collect()] == [(3, "O")]


def test_archive_listing_windows_and_markers(spark, tmp_path):
    for n in ("rib.ris.20260101.0000.rrc00.gz", "rib.ris.20260101.0800.rrc00.gz", "upd.rv.20260101.0015.sg.bz2", "upd.rv.20260101.0015.sg.bz2.tmp", "x.txt"):
        (tmp_path / n).write_bytes(b"1")
    a = readers.list_archives(spark, str(tmp_path))
    assert a.count() == 3
    lit = lambda s: F.lit(s).cast("timestamp")
    assert [r.dest for r in readers.window_tasks(a, lit("2026-01-01 00:00"), lit("2026-01-01 08:00")).collect()] == ["rib.ris.20260101.0000.rrc00", "upd.rv.20260101.0015.sg"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "m.json").write_text(json.dumps({"timestamp": "t", "data_type": "upd", "missing_collectors_by_source": {"ris": ["01", "02"], "rv": []}}))
    assert sorted(r.collector for r in readers.read_done_markers(spark, str(tmp_path / "d")).collect()) == ["01", "02"]


def test_route_filters_and_stream_times(spark, tmp_path):
    fields = "rec_id long, ts timestamp, source string, event string, as_path array<long>, origin_asn long"
    rows = [(1, "RIB", "A", [1, 2], 2), (2, "RIB", "A", [2], 2), (3, "UPD", "W", [], None), (4, "UPD", "A", [1, 2], 2)]
    d = spark.createDataFrame([(i, None, s, e, p, o) for i, s, e, p, o in rows], fields)
    assert [r.rec_id for r in readers.rib_records(d).collect()] == [1] and [r.rec_id for r in readers.update_records(d).collect()] == [4]
    full = d.select(*(F.col(c) if c in d.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in schemas.ROUTE_RECORD.split(", "))))
    full.coalesce(1).write.parquet(str(tmp_path / "r"))
    assert readers.read_routes(spark, str(tmp_path / "r")).count() == 4
    assert readers.stream_routes(spark, str(tmp_path / "r")).isStreaming


def test_finished_runs_and_splits(spark, tmp_path):
    for n, s in (("a", "complete"), ("b", "failed")):
        (tmp_path / n).mkdir()
        (tmp_path / n / "manifest.json").write_text(json.dumps({"status": s, "geometry": "hyperbolic", "dimension": 8, "k": 2, "seed": 1}))
    assert [r.dimension for r in readers.finished_runs(spark, str(tmp_path)).collect()] == [8]
    d = spark.createDataFrame([(1, "org_id"), (2, ""), (3, None)], "id long, reason string")
    sinks.write_split(d, "reason", str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out_anom")).count() == 2
