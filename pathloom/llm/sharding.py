"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``vnodes`` points on a ring; a document belongs to the first point clockwise from the hash of its id, and if
that point's shard is full it goes on clockwise to the next shard with room. Documents take their places in an order of their
own (a hash of the id, then of the text, then the row), so the result is that of one document after another and doesn't
depend on how the rows are dealt. The bounds add up to the number of documents (law ``rows``: all are full in the end, counts
are at most one apart); with ``slack`` they are looser, and fewer documents leave the shard that the ring alone gives them.

No document is placed one after another in the driver for that. What decides is after which document in the order each shard
is full, one event for each shard. Counts by (point, 7 bits of the order) show between which bits an event falls; only those
bits are looked at again, by the next 7, and the documents of a cell come to the driver only where at most ``most_rows`` share
it. So the driver gets points x 128 counts at a time, whatever the number of documents, and a hot id is split by its texts and
rows. Then each document's shard follows from its point and the number of events before it: a table of points x (shards + 1).

Numbers in a shard come from one range partitioning of short rows by (shard, order) and the counts of its partitions. Texts
are never shuffled, except by ``write``.

Defined cases: null text has no bytes; null ids share one point of the ring; repeated rows are each placed, one after another;
with fewer documents than shards some shards are empty; an empty table gives no rows; extra columns are ignored, but kept
by ``write``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow, fresh, materialize, parts, temporary

BITS, DIGITS = 7, 9  # a key is three columns of 63 bits
KEY = ("p", "q", "uid")
TOP = (1 << BITS * DIGITS) - 1
Key = tuple[int, int, int]


class Ring:
    """Points in order, their shards, and for each point the shards in the order a document meets them."""

    def __init__(self, shards: int, vnodes: int):
        place = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest()) >> 1
        points = sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))
        self.shards, self.at, self.owner = shards, np.array([p for p, _ in points], np.int64), [s for _, s in points]
        walk: list[list[int]] = [[] for _ in points]
        ahead: list[int] = []
        for k in reversed(range(2 * len(points))):  # twice round: what is ahead of the last point is at the beginning
            s = self.owner[k % len(points)]
            ahead = [s, *(x for x in ahead if x != s)]
            walk[k % len(points)] = ahead
        self.walk = np.array(walk, np.int64)

    def open(self, full: set[int]) -> np.ndarray:
        """For each point the first shard that isn't full (0 if all are)."""
        free = ~np.isin(self.walk, list(full)) if full else np.ones(self.walk.shape, bool)
        return self.walk[np.arange(len(self.walk)), free.argmax(axis=1)]


def _hash(*of: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 1)


def _keys(rows: DataFrame, ring: Ring) -> DataFrame:
    """(uid, id, text) -> doc_id, size, text_crc32, key columns, arc."""
    text = F.col("text").cast("binary")
    d = rows.select(
        F.col("id").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
        _hash(F.lit("order"), "id").alias("p"), _hash(F.lit("text"), text).alias("q"), "uid", _hash(F.lit("point"), "id").alias("point"),
    )

    def find(batches):
        for b in batches:
            arcs = np.searchsorted(ring.at, b.column(6).to_numpy()) % len(ring.at)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(arcs, pa.int32())], names=[*b.schema.names[:6], "arc"])

    return arrow(d, find, "doc_id long, size long, text_crc32 long, p long, q long, uid long, arc int")


def _span(prefix: int, level: int) -> tuple[Key, Key]:
    """The least and greatest key whose first ``level`` digits are ``prefix``."""
    left = 3 * BITS * DIGITS - BITS * level
    low, high = prefix << left, ((prefix + 1) << left) - 1
    cut = lambda k: (k >> 2 * BITS * DIGITS, k >> BITS * DIGITS & TOP, k & TOP)
    return cut(low), cut(high)


def _within(prefix: int, level: int) -> Column:
    low, high = _span(prefix, level)
    found = F.lit(True)
    for c, a, b in zip(KEY, low, high, strict=True):
        found = found & (F.col(c) == a if a == b else F.col(c).between(a, b) if (a, b) != (0, TOP) else F.lit(True))
    return found


def events(keys: DataFrame, ring: Ring, bounds: list[int], most_rows: int = 20_000) -> list[tuple[Key, int]]:
    """The keys after which each shard that fills up is full, in order."""
    room = np.array(bounds, np.int64)
    full = {s for s, r in enumerate(bounds) if not r}
    found: list[tuple[Key, int]] = [((-1, -1, -1), s) for s in sorted(full)]
    now = [ring.open(full)]

    def filled(key: Key) -> None:
        for s in np.flatnonzero(room == 0).tolist():
            if s not in full:
                full.add(s)
                found.append((key, s))
        now[0] = ring.open(full)

    def settle(prefix: int, level: int) -> None:
        column, below = KEY[level // DIGITS], BITS * (DIGITS - 1 - level % DIGITS)
        digit = F.shiftright(column, below).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).alias("digit")
        cells = keys.where(_within(prefix, level)).groupBy(digit, "arc").agg(F.count("*").alias("n")).toPandas()  # 128 x points at most
        for k, cell in cells.groupby("digit"):  # in order
            inner, arcs, n = prefix << BITS | int(k), cell["arc"].to_numpy(), cell["n"].to_numpy()
            need = np.bincount(now[0][arcs], n, len(room)).astype(np.int64)
            if (need <= room).all():
                room[:] -= need
                if ((room == 0) & (need > 0)).any():
                    filled(_span(inner, level + 1)[1])
            elif n.sum() <= most_rows:
                rows = keys.where(_within(inner, level + 1)).select(*KEY, "arc").toPandas().sort_values(list(KEY))
                for p, q, uid, arc in rows.itertuples(index=False):
                    s = now[0][arc]
                    room[s] -= 1
                    if not room[s]:
                        filled((p, q, uid))
            else:
                settle(inner, level + 1)

    if not keys.isEmpty():
        settle(0, 0)
    return found


def _bounds(n: int, shards: int, slack: float) -> list[int]:
    even = [n // shards + (s < n % shards) for s in range(shards)]
    return [int(b * (1 + slack)) for b in even]


def _placed(rows: DataFrame, shards: int, vnodes: int, slack: float, most_rows: int) -> DataFrame:
    """(uid, id, text) -> uid, doc_id, size, text_crc32, shard, slot."""
    spark, ring = rows.sparkSession, Ring(shards, vnodes)
    keys = materialize(_keys(rows, ring).sortWithinPartitions(*KEY), "sharding-keys")  # sorted: the cells' filters skip pages
    found = events(keys, ring, _bounds(keys.count(), shards, slack), most_rows)
    after = [np.array([k[c] for k, _ in found], np.int64) for c in range(3)]
    target = np.stack([ring.open({s for _, s in found[:e]}) for e in range(len(found) + 1)], axis=1)

    def place(batches):
        for b in batches:
            p, q, uid, arc = (b.column(k).to_numpy() for k in range(3, 7))
            before = np.zeros(b.num_rows, np.int64)
            for ep, eq, eu in zip(*after, strict=True):
                before += (p > ep) | (p == ep) & ((q > eq) | (q == eq) & (uid > eu))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(target[arc, before], pa.int32())], names=[*b.schema.names[:6], "shard"])

    d = arrow(keys, place, "doc_id long, size long, text_crc32 long, p long, q long, uid long, shard int")
    order = ["shard", *KEY]
    d = materialize(d.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sharding-order")
    runs = d.groupBy(F.shiftright("at", 33).alias("part"), "shard").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # of partitions, each in order
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("part", F.col("shard").alias("of"), (before - F.col("first")).alias("add"))
    found_in = (F.shiftright("at", 33) == F.col("part")) & (F.col("shard") == F.col("of"))
    placed = d.join(F.broadcast(runs), found_in)  # partitions + shards rows at most
    return placed.select("uid", "doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("add")).cast("long").alias("slot"))


def assign(docs: DataFrame, shards: int = 16, vnodes: int = 128, slack: float = 0.0, most_rows: int = 20_000) -> DataFrame:
    """Per row: doc_id, size (bytes of the text and one), text_crc32, shard, slot (from 0 in each shard)."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    with temporary(docs.sparkSession):
        return materialize(_placed(rows, shards, vnodes, slack, most_rows).drop("uid"), "sharding", keep=True)


def write(docs: DataFrame, path: str, shards: int = 16, **how) -> None:
    """Whole rows as Parquet, a folder for each shard, in order of ``slot``; columns named shard or slot give way."""
    uid = fresh(docs, "uid")
    with temporary(docs.sparkSession):
        numbered = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "sharding-rows")
        rows = numbered.select(F.col(uid).alias("uid"), numbered["doc_id"].cast("long").alias("id"), numbered["text"].cast("string").alias("text"))
        where = _placed(rows, shards, how.get("vnodes", 128), how.get("slack", 0.0), how.get("most_rows", 20_000)).select(F.col("uid").alias(uid), "shard", "slot")
        kept = numbered.drop("shard", "slot").join(where, uid).drop(uid)
        kept.repartitionByRange(parts(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def report(docs: DataFrame, shards: int = 16) -> DataFrame:
    d = assign(docs, shards)
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
