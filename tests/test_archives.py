import os
import threading
from datetime import UTC, datetime, timedelta
from functools import partial
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from pathloom.sources import archives as A

JAN, MAR = datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 3, 1, tzinfo=UTC)


@pytest.fixture
def mirror(tmp_path):
    """A web server over folders, whose listings have a link for each file; it notes what was asked for and can fail."""

    class Handler(SimpleHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            if any(x in self.path for x in broken):
                self.send_error(500)
            else:
                super().do_GET()

        def log_message(self, *_):
            pass

    asked, broken = [], []
    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(Handler, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def put(*names):
        for n in names:
            (tmp_path / os.path.dirname(n)).mkdir(parents=True, exist_ok=True)
            (tmp_path / n).write_bytes(b"1")

    put("ris/rrc00/2024.01/bview.20240101.0000.gz", "ris/rrc00/2024.01/updates.20240101.0005.gz", "ris/rrc00/2024.01/updates.20240131.2355.gz", "ris/rrc00/2024.01/notes.txt", "ris/rrc00/2024.01/updates.bad.gz")
    put("ris/rrc00/2024.02/updates.20240201.0000.gz", "ris/rrc01/2024.02/updates.20240203.0000.gz")
    put("rv/sg/bgpdata/2024.01/RIBS/rib.20240101.0200.bz2", "rv/sg/bgpdata/2024.01/RIBS/rib.20240101.0400.bz2", "rv/sg/bgpdata/2024.01/UPDATES/updates.20240101.0015.bz2")
    yield f"http://127.0.0.1:{server.server_port}", asked, broken, put
    server.shutdown()


def names(df):
    return sorted(r.name for r in df.where("status = 'ok'").collect())


def test_months_and_times():
    assert A.months(datetime(2023, 12, 31, 23, tzinfo=UTC), datetime(2024, 2, 1, tzinfo=UTC)) == ["2023.12", "2024.01"] and A.months(JAN, JAN) == []
    assert A.file_time("rib.20240101.0200.bz2") == datetime(2024, 1, 1, 2, tzinfo=UTC) and A.file_time("a.b.c") is None and A.file_time("updates.bad.x.gz") is None


def test_a_partition_for_each_month_and_collector(spark, mirror):
    root, asked, _, _ = mirror
    d = A.listing(spark, "ris", f"{root}/ris", ["00", "01"], JAN, MAR)
    assert d.rdd.getNumPartitions() == 4
    assert names(d) == ["bview.20240101.0000.gz", "updates.20240101.0005.gz", "updates.20240131.2355.gz", "updates.20240201.0000.gz", "updates.20240203.0000.gz"]
    assert {(r.collector, r.month, r.type) for r in d.where("status = 'empty'").collect()} == {("00", "2024.02", "rib"), ("01", "2024.01", "rib"), ("01", "2024.01", "upd"), ("01", "2024.02", "rib")}
    rv = A.listing(spark, "rv", f"{root}/rv", ["sg"], JAN, datetime(2024, 1, 2, tzinfo=UTC))
    assert names(rv) == ["rib.20240101.0400.bz2", "updates.20240101.0015.bz2"]  # snapshots every four hours only


def test_filters_leave_pages_unread(spark, mirror):
    root, asked, _, _ = mirror
    asked.clear()
    d = A.listing(spark, "ris", f"{root}/ris", ["00", "01", "02"], JAN, MAR).where((F.col("collector") == "00") & (F.col("ts") >= F.lit(datetime(2024, 2, 1, tzinfo=UTC))))
    assert names(d) == ["updates.20240201.0000.gz"] and asked == ["/ris/rrc00/2024.02/"]
    asked.clear()
    assert names(A.listing(spark, "rv", f"{root}/rv", ["sg", "eq"], JAN, datetime(2024, 2, 1, tzinfo=UTC)).where("type = 'upd' and collector in ('sg')")) == ["updates.20240101.0015.bz2"]
    assert asked == ["/rv/sg/bgpdata/2024.01/UPDATES/"]
    assert A.listing(spark, "ris", f"{root}/ris", ["00"], JAN, MAR).where("collector = 'zz'").collect() == []


def test_cache_by_age_and_failures(spark, mirror, tmp_path):
    root, asked, broken, put = mirror
    cache, end = str(tmp_path / "cache"), datetime(2024, 2, 10, tzinfo=UTC)
    read = lambda now, kind="upd": A.cached_listing(spark, cache, "ris", kind, f"{root}/ris", ["00", "01"], JAN, end, now, wait="0")
    soon, late = end + timedelta(hours=1), end + timedelta(hours=3)
    all_four = ["updates.20240101.0005.gz", "updates.20240131.2355.gz", "updates.20240201.0000.gz", "updates.20240203.0000.gz"]
    assert names(read(soon)) == all_four
    put("ris/rrc01/2024.02/updates.20240204.0000.gz")
    asked.clear()
    assert names(read(late)) == all_four and asked == []  # old enough: from the cache alone
    assert names(read(soon)) == [*all_four, "updates.20240204.0000.gz"] and len(asked) == 4  # not old enough: read anew
    broken.append("rrc01")
    asked.clear()
    assert names(read(soon)) == [*all_four, "updates.20240204.0000.gz"] and sum("rrc01/2024.02" in x for x in asked) == A.TRIES  # failed: from the cache
    got = read(soon, "rib")  # never listed before
    assert names(got) == ["bview.20240101.0000.gz"] and {(r.collector, r.month) for r in got.where("status like 'failed%'").collect()} == {("01", "2024.01"), ("01", "2024.02")}
    broken.clear()
    asked.clear()
    assert names(read(end + timedelta(hours=13), "rib")) == ["bview.20240101.0000.gz"] and sorted(asked) == ["/ris/rrc01/2024.01/", "/ris/rrc01/2024.02/"]  # only what the cache hasn't


def test_tasks_of_a_window(spark, mirror):
    root, _, _, _ = mirror
    start, end = datetime(2024, 1, 1, 0, 5, tzinfo=UTC), datetime(2024, 1, 31, 23, 55, tzinfo=UTC)
    got = A.tasks(A.listing(spark, "ris", f"{root}/ris", ["00"], start, end), start, end, "raw/").collect()
    assert [(r.url, r.dest, r.collector) for r in got] == [(f"{root}/ris/rrc00/2024.01/updates.20240101.0005.gz", "raw/upd.ris.20240101.0005.00.gz", "00")]
