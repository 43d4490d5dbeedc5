"""Listings of the two archive families as Spark data sources, and fetch tasks over a listing cache.

Each family is a ``DataSource`` with one partition for each month and collector, so a listing of years runs as that many tasks;
filters on ``collector``, ``ts`` and ``type`` are pushed down and leave partitions (and pages) unread. A page that isn't there is empty;
others are tried three times, and then its partition gives one row that says so. Pages are read by URL (http, https, file).

``tasks`` keeps what was listed in a cache table. Windows that ended long enough ago are taken from it alone where it has an
entry; otherwise pages are listed anew, and a page that fails falls back to its entry. The cache only grows by whole
appends, and of a page's entries the latest holds.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.error import HTTPError
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..storage import stored
from . import commits

SHAPE = "source string, type string, collector string, month string, page string, name string, ts timestamp, status string"
LINK = re.compile(r'href="([^"]*\.(?:gz|bz2))"')
TRIES = 3
# fixed values: a window that ended so many hours ago is taken from the cache
CACHE_ONLY_HOURS = {("ris", "upd"): 2, ("rv", "upd"): 2, ("ris", "rib"): 12, ("rv", "rib"): 4}


def months(start: datetime, end: datetime) -> list[str]:
    """YYYY.mm of each month that [start, end) touches."""
    out, at = [], start.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    while at < end:
        out.append(at.strftime("%Y.%m"))
        at = (at + timedelta(days=32)).replace(day=1)
    return out


def file_time(name: str) -> datetime | None:
    """Out of the last but two and last but one part of a name."""
    parts = name.split(".")
    try:
        return datetime.strptime(parts[-3] + parts[-2], "%Y%m%d%H%M").replace(tzinfo=UTC) if len(parts) > 3 else None
    except ValueError:
        return None


def page_links(url: str, timeout: float, wait: float = 1.0) -> list[str]:
    """Archive names on a page; none if there is no such page."""
    for attempt in range(TRIES):
        try:
            with urlopen(url, timeout=timeout) as page:
                return LINK.findall(page.read().decode("utf-8", "replace"))
        except HTTPError as e:
            if e.code == 404:
                return []
            failed = e
        except FileNotFoundError:
            return []
        except OSError as e:
            if isinstance(getattr(e, "reason", None), FileNotFoundError):
                return []
            failed = e
        if attempt + 1 < TRIES:
            time.sleep(wait * 2**attempt)
    raise failed


class Page(InputPartition):
    def __init__(self, collector: str, month: str, kinds: tuple[str, ...]):
        self.collector, self.month, self.kinds = collector, month, kinds


class ArchiveReader(DataSourceReader):
    """What both families share. Options: root, collectors (comma-joined), start, end (ISO), pages (collector/month, comma-joined;
    all of both if missing), timeout, wait."""

    source = ""

    def __init__(self, options):
        self.root = options["root"].rstrip("/")
        self.start, self.end = (datetime.fromisoformat(options[k]).replace(tzinfo=UTC) for k in ("start", "end"))
        self.collectors = [c for c in options.get("collectors", "").split(",") if c]
        self.only = set(options["pages"].split(",")) if "pages" in options else None
        self.timeout, self.wait, self.index = float(options.get("timeout", "30")), float(options.get("wait", "1")), options.get("index", "")
        self.kinds: tuple[str, ...] = ("rib", "upd")
        self.low, self.high = self.start, self.end

    def pushFilters(self, filters):
        """Pages outside the filters aren't read; times are left to Spark too, as a page holds a month."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = list(f.value) if isinstance(f, In) else [f.value] if isinstance(f, EqualTo) else None
            if values is not None and column == "collector":
                self.collectors = [c for c in self.collectors if c in values]
            elif values is not None and column == "type":
                self.kinds = tuple(k for k in self.kinds if k in values)
            elif column == "ts" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value.astimezone(UTC) if f.value.tzinfo else f.value.replace(tzinfo=UTC))
                yield f
            elif column == "ts" and isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, (f.value.astimezone(UTC) if f.value.tzinfo else f.value.replace(tzinfo=UTC)) + timedelta(seconds=1))
                yield f
            else:
                yield f

    def partitions(self) -> list[Page]:
        pages = [Page(c, m, self.kinds) for m in months(self.low, self.high) for c in self.collectors if self.only is None or f"{c}/{m}" in self.only]
        return pages or [Page("", "", ())]

    def pages(self, p: Page) -> list[tuple[str, str | None]]:
        """(URL, kind) of the pages of a collector and month; the kind is in the names where it is null."""
        raise NotImplementedError

    def read(self, p: Page) -> Iterator[tuple]:
        for url, kind in self.pages(p) if p.kinds else ():
            try:
                names = page_links(url + self.index, self.timeout, self.wait)
            except OSError as e:
                for k in (kind,) if kind else p.kinds:
                    yield self.source, k, p.collector, p.month, url, None, None, f"failed: {e}"[:200]
                continue
            found: dict[str, int] = dict.fromkeys((kind,) if kind else p.kinds, 0)
            for name in names:
                at, k = file_time(name), kind or ("rib" if name.startswith(("bview.", "rib.")) else "upd" if name.startswith("updates.") else None)
                if at is not None and k in found and self.wanted(k, at):
                    found[k] += 1
                    yield self.source, k, p.collector, p.month, url, name, at, "ok"
            for k, n in found.items():
                if not n:
                    yield self.source, k, p.collector, p.month, url, None, None, "empty"

    def wanted(self, kind: str, at: datetime) -> bool:
        return True


class RisReader(ArchiveReader):
    """One page for each collector and month: <root>/rrc<collector>/<month>."""

    source = "ris"

    def pages(self, p):
        return [(f"{self.root}/rrc{p.collector}/{p.month}/", None)]


class RvReader(ArchiveReader):
    """Snapshots and updates on pages of their own; snapshots of the minute 0 of every fourth hour only."""

    source = "rv"

    def pages(self, p):
        return [(f"{self.root}/{p.collector}/bgpdata/{p.month}/{folder}/", kind) for kind, folder in (("rib", "RIBS"), ("upd", "UPDATES")) if kind in p.kinds]

    def wanted(self, kind, at):
        return kind != "rib" or at.minute == 0 and at.hour % 4 == 0


class RisArchives(DataSource):
    made = RisReader

    @classmethod
    def name(cls) -> str:
        return "ris_archives"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> DataSourceReader:
        return self.made(self.options)


class RvArchives(RisArchives):
    made = RvReader

    @classmethod
    def name(cls) -> str:
        return "rv_archives"


FAMILIES = {"ris": RisArchives, "rv": RvArchives}


def listing(spark: SparkSession, source: str, root: str, collectors: list[str], start: datetime, end: datetime, **more: str) -> DataFrame:
    """The family's listing of all months that [start, end) touches, with a row for each empty or failed page."""
    spark.dataSource.register(FAMILIES[source])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    iso = lambda t: t.astimezone(UTC).replace(tzinfo=None).isoformat()
    return spark.read.format(FAMILIES[source].name()).options(root=root, collectors=",".join(collectors), start=iso(start), end=iso(end), **more).load()


def cached_listing(spark: SparkSession, cache: str, source: str, kind: str, root: str, collectors: list[str], start: datetime, end: datetime, now: datetime | None = None, **more: str) -> DataFrame:
    """``listing`` of one kind over the cache table at ``cache``; pages that failed and have no entry keep their row."""
    now = now or datetime.now(UTC)
    shape = SHAPE + ", read_at timestamp, batch string"
    parts = [n for n in commits.names(spark, cache) if n.startswith("batch=") and commits.exists(spark, f"{cache}/{n}/_SUCCESS")]
    old = spark.read.schema(shape).parquet(*(f"{cache}/{n}" for n in parts)) if parts else spark.createDataFrame([], shape)
    page = ["source", "type", "page"]
    mine = old.where((F.col("source") == source) & (F.col("type") == kind) & F.col("month").isin(months(start, end)) & F.col("collector").isin(collectors))
    last = Window.partitionBy(*page)  # of one page, a month of one collector
    known = mine.withColumn("top", F.max(F.struct("read_at", "batch")).over(last)).where((F.col("top.read_at") == F.col("read_at")) & (F.col("top.batch") == F.col("batch"))).drop("top")
    settled = now - end > timedelta(hours=CACHE_ONLY_HOURS[source, kind])
    names = SHAPE.replace(" string", "").replace(" timestamp", "").split(", ")
    if settled:  # a row for each page: months times collectors
        have = {f"{r.collector}/{r.month}" for r in known.select("collector", "month").distinct().collect()}
        more["pages"] = ",".join(p for p in (f"{c}/{m}" for m in months(start, end) for c in collectors) if p not in have) or "none"
    read = stored(listing(spark, source, root, collectors, start, end, **more).where(F.col("type") == kind), "listing")
    batch = f"{now.astimezone(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex}"
    good = read.where(~F.startswith("status", F.lit("failed")))
    if not good.isEmpty():
        good.withColumns({"read_at": F.lit(now), "batch": F.lit(batch)}).write.parquet(f"{cache}/batch={batch}")
    kept = known.select(*names).join(good.select(*page).distinct(), page, "left_anti")
    failed = read.where(F.startswith("status", F.lit("failed"))).join(kept.select(*page).distinct(), page, "left_anti")
    return good.unionByName(kept).unionByName(failed)


def tasks(listed: DataFrame, start: datetime, end: datetime, folder: str) -> DataFrame:
    """(url, dest, ts, collector) of a listing's archives with start <= ts < end, in order of time."""
    parts = F.split("name", r"\.")
    dest = F.concat_ws(".", "type", "source", F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), "collector", F.element_at(parts, -1))
    rows = listed.where((F.col("status") == "ok") & (F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
    return rows.select(F.concat("page", "name").alias("url"), F.concat(F.lit(folder.rstrip("/") + "/"), dest).alias("dest"), "ts", "collector").orderBy("ts", "url")
