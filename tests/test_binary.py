import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pathloom.sources import binary as B


def rows(df):
    return sorted(map(str, df.collect()))


def test_triplets_round_trip_and_splits(spark, tmp_path):
    d = spark.range(1000).select(F.col("id").alias("profile_id"), (F.col("id") % 7).alias("as_id"), (F.col("id") % 256).cast("short").alias("hop"), (F.col("id") / 3).cast("float").alias("weight"))
    at = str(tmp_path / "t")
    B.write_binary(d.repartition(3), at, "profile_triplets")
    got = B.read_binary(spark, at, "profile_triplets", split=13 * 100)
    assert rows(got) == rows(d) and got.rdd.getNumPartitions() >= 10  # cut at record borders
    assert got.schema == d.schema or [f.dataType for f in got.schema] == [f.dataType for f in d.schema]
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(".")] and (tmp_path / "t" / "_SUCCESS").exists()


def test_bytes_are_those_of_the_layout(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(struct.pack("<Q", 2) + struct.pack("<iiBf", 1, 2, 3, 0.5) + struct.pack("<iiBf", -1, 7, 255, 1.0))
    assert [tuple(r) for r in B.read_binary(spark, str(tmp_path / "x.bin"), "profile_triplets").collect()] == [(1, 2, 3, 0.5), (-1, 7, 255, 1.0)]
    (tmp_path / "f.bin").write_bytes(struct.pack("<QQQQ", 1, 2**64 - 1, 3, 4))
    assert [tuple(r) for r in B.read_binary(spark, str(tmp_path / "f.bin"), "profile_fingerprints").collect()] == [(0, 1, -1), (1, 3, 4)]


def test_places_go_on_over_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.bin").write_bytes(struct.pack("<3i", 5, -1, 7))
    (tmp_path / "p" / "b.bin").write_bytes(struct.pack("<2i", 8, 9))
    got = B.read_binary(spark, str(tmp_path / "p"), "prefix_to_profile", split=8)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 5), (1, -1), (2, 7), (3, 8), (4, 9)]
    B.write_binary(got.orderBy("prefix_id"), str(tmp_path / "q"), "prefix_to_profile")
    assert rows(B.read_binary(spark, str(tmp_path / "q"), "prefix_to_profile")) == rows(got)


def test_routes_and_prefixes(spark, tmp_path):
    many = [(i, i + 1) for i in range(27)]
    data = [("10.1.2.0/24", 1_700_000_000, 2**32 - 1, 7, 0, 1, "A", many), ("2001:db8::/32", 5, 0, 0, 4, 0, "W", [])]
    d = spark.createDataFrame(data, B.SHAPES["route_cache"])
    B.write_binary(d.coalesce(1), str(tmp_path / "r"), "route_cache")
    assert rows(B.read_binary(spark, str(tmp_path / "r"), "route_cache")) == rows(d)
    part = next((tmp_path / "r").glob("part-*"))
    assert part.stat().st_size == 8 + 2 * 256
    m = spark.createDataFrame([("10.0.0.0/8", 3), ("::/0", -1)], B.SHAPES["prefix_profile_map"])
    B.write_binary(m, str(tmp_path / "m"), "prefix_profile_map")
    assert rows(B.read_binary(spark, str(tmp_path / "m"), "prefix_profile_map")) == rows(m)
    assert B.prefix_text(B.prefix_bytes("10.1.2.3/16")) == "10.1.0.0/16"


def test_paths_of_any_length(spark, tmp_path):
    d = spark.range(3000).select(F.col("id").alias("prefix_id"), F.transform(F.sequence(F.lit(0), (F.col("id") % 256).cast("int")), lambda x: (x * 7).cast("long")).alias("path")).select("prefix_id", F.slice("path", F.lit(1), (F.col("prefix_id") % 256).cast("int")).alias("path"))
    B.write_binary(d, str(tmp_path / "c"), "compact_paths")
    assert rows(B.read_binary(spark, str(tmp_path / "c"), "compact_paths")) == rows(d)


@pytest.mark.parametrize(
    "layout,data,says",
    [
        ("profile_triplets", struct.pack("<Q", 2) + struct.pack("<iiBf", 1, 2, 3, 0.5), "expected 34 bytes for 2 records, found 21"),
        ("profile_triplets", struct.pack("<Q", 1) + b"123", "truncated"),
        ("profile_triplets", b"123", "no count"),
        ("prefix_to_profile", b"12345", "truncated"),
        ("compact_paths", struct.pack("<Q", 2) + struct.pack("<iBI", 1, 1, 5) + struct.pack("<iB", 2, 3), "truncated at record 1 of 2"),
        ("compact_paths", struct.pack("<Q", 1) + struct.pack("<iBI", 1, 1, 5) + b"xx", "2 bytes after the last of 1"),
    ],
)
def test_cut_files_are_refused(spark, tmp_path, layout, data, says):
    (tmp_path / "cut.bin").write_bytes(data)
    with pytest.raises(PySparkException, match=says):
        B.read_binary(spark, str(tmp_path / "cut.bin"), layout).collect()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    d = spark.createDataFrame([(1, [1] * 5), (2, [1] * 256)], B.SHAPES["compact_paths"]).repartition(2, "prefix_id")
    with pytest.raises(PySparkException, match="255 at most"):
        B.write_binary(d, str(tmp_path / "w"), "compact_paths")
    assert not (tmp_path / "w").exists() or not list((tmp_path / "w").iterdir())
    good = d.where("prefix_id = 1")
    B.write_binary(good, str(tmp_path / "w"), "compact_paths")
    with pytest.raises(PySparkException, match="FileExists"):
        B.write_binary(good, str(tmp_path / "w"), "compact_paths")
    B.write_binary(good.select(F.lit(9).cast("long").alias("prefix_id"), "path"), str(tmp_path / "w"), "compact_paths", overwrite=True)
    assert [r.prefix_id for r in B.read_binary(spark, str(tmp_path / "w"), "compact_paths").collect()] == [9]
    with pytest.raises(PySparkException, match="beyond"):
        B.write_binary(spark.createDataFrame([(2**31, 1, 1, 1.0)], B.SHAPES["profile_triplets"]), str(tmp_path / "z"), "profile_triplets")
