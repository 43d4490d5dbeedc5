import base64
import gzip
import hashlib

import pytest

from pathloom.llm import warc


def check(rows, got, least=0):
    groups = {}
    for p, h in rows:
        groups.setdefault((h or "").encode(), []).append(p)
    want = []
    for data, ids in groups.items():
        digest, real = base64.b32encode(hashlib.sha1(data).digest()).decode(), [i for i in ids if i is not None]
        for i in ids:
            top = max(real) if real and len(ids) > 1 and len(data) >= least else None
            want.append((i, len(data), digest, *(("response", None) if top is None or i == top else ("revisit", top))))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)


def test_round_trip(spark):
    rows = [(1, "<p>a</p>"), (2, "<p>a</p>"), (9, "<p>ä\r\n\r\nWARC/1.1\r\n</p>"), (3, None), (4, ""), (5, "x" * 300_001), (6, "x" * 300_001), (7, "y" * warc.CHUNK), (8, "🙂"), (2, "<p>a</p>"), (None, "<p>a</p>"), (None, "alone")]
    df = spark.createDataFrame([(p, "http://x /\ny" if p else None, h, "n") for p, h in rows], "page_id long, url string, html string, record string").repartition(3)
    chunks = warc.write(df)
    assert max(len(r.data) for r in chunks.collect()) <= warc.CHUNK
    check(rows, warc.read(chunks).collect())
    check(rows, warc.read(warc.write(df, min_bytes=5)).collect(), 5)
    plain = b"".join(gzip.decompress(m) for a in {r.archive for r in chunks.select("archive").distinct().collect()} for m in warc.export(chunks, a))
    assert plain.count(b"WARC-Record-ID") == len(rows) and b"x" * 300_001 + b"\r\n\r\n" in plain


def test_groups_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "FEW_GROUPS", 0)
    rows = [(i, "same" if i % 3 else f"p{i}") for i in range(60)]
    check(rows, warc.read(warc.write(spark.createDataFrame([(p, "u", h) for p, h in rows], "page_id long, url string, html string"))).collect())


def test_empty(spark):
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_parser_in_any_portions():
    data = warc._header(5, "http://u/", base64.b32encode(hashlib.sha1(b"hello").digest()).decode(), 5, None, False) + b"hello\r\n\r\n"
    for n in (1, 2, 7, 1000):
        p = warc.Parser()
        for at in range(0, len(data), n):
            p.feed(data[at : at + n])
        assert p.close()["payload_bytes"] == 5


def test_a_broken_chunk_names_itself(spark):
    df = spark.createDataFrame([(1, "u", "x" * 200_000)], "page_id long, url string, html string")
    chunks = warc.write(df)
    assert warc.read(chunks).count() == 1
    from pyspark.sql import functions as F

    broken = chunks.withColumn("data", F.when(F.col("chunk") == 2, F.translate(F.col("data").cast("string"), "x", "y").cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="chunk 2 has another digest"):
        warc.read(broken).collect()
