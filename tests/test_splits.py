"""The number of splits doesn't grow with the records."""

from pathloom.sources import binary as B


def test_splits_widen_instead_of_growing_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "MOST_SPLITS", 8, raising=False)
    rows = spark.range(5000).coalesce(2).selectExpr("id profile_id", "id % 7 as_id", "cast(id % 5 as short) hop", "cast(0.5 as float) weight")
    B.write_binary(rows, str(tmp_path / "t"), "profile_triplets")
    reader = B.FixedReader({"path": str(tmp_path / "t"), "layout": "profile_triplets", "split": "130"})
    splits = reader.partitions()
    assert len(splits) <= 8 + 2 and sum(p.count for p in splits) == 5000
    assert sorted(x for p in splits for b in reader.read(p) for x in b.column("profile_id").to_pylist()) == list(range(5000))
