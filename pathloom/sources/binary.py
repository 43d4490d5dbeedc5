"""Binary tables of fixed-width records as a Spark data source: ``spark.read.format("fixed_width").option("layout", ..)``.

A file is an optional count (eight bytes, little-endian) and that many records. Files are cut at record borders into splits of
about ``split`` bytes, larger ones where they would be more than ``MOST_SPLITS`` (up to ``WIDEST``); each is read by one task in blocks and decoded in whole columns. Sizes are checked from the listing
alone, counts by the first split's task, and an error names the file, what it should have and what it has, so a truncated file
never gives rows. Records of the ``compact_paths`` layout have a length of their own: such a file is one split, read in
blocks.

Positional layouts (no key in the record) give each record its place over all files in order of their names.

Writing is transactional: tasks write under unfinished names, which the commit renames when all are there; an aborted job leaves
nothing. Paths are URLs that ``pyarrow.fs`` opens (local, or a store it knows).
"""

from __future__ import annotations

import ipaddress
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

COUNT, BLOCK = 8, 1 << 20
MOST_SPLITS, WIDEST = 256, 64 << 20
PAIRS = 27
# fixed values: the layouts of the files
PREFIX = ("prefix", "u1", (16,))
DTYPES = {
    "profile_triplets": [("profile_id", "<i4"), ("as_id", "<i4"), ("hop", "u1"), ("weight", "<f4")],
    "prefix_to_profile": [("profile_id", "<i4")],
    "profile_fingerprints": [("lo", "<i8"), ("hi", "<i8")],
    "prefix_profile_map": [PREFIX, ("profile_id", "<i4")],
    "route_cache": [PREFIX, ("ts", "<i8"), ("origin_asn", "<u4"), ("peer_asn", "<u4"), ("signal", "u1"), ("n_links", "u1"), ("community", "u1"), ("event", "u1"), ("links", "<u4", (PAIRS, 2)), ("padding", "V4")],
    "compact_paths": [("prefix_id", "<i4"), ("n", "u1")],
}
SHAPES = {
    "profile_triplets": "profile_id long, as_id long, hop short, weight float",
    "prefix_to_profile": "prefix_id long, profile_id long",
    "profile_fingerprints": "profile_id long, lo long, hi long",
    "prefix_profile_map": "prefix string, profile_id long",
    "route_cache": "prefix string, ts long, origin_asn long, peer_asn long, signal int, community int, event string, links array<struct<from_as:long,to_as:long>>",
    "compact_paths": "prefix_id long, path array<long>",
}
COUNTED = {"profile_triplets", "prefix_profile_map", "route_cache", "compact_paths"}
PLACES = {"prefix_to_profile": "prefix_id", "profile_fingerprints": "profile_id"}


def prefix_text(raw: bytes) -> str:
    """Fourteen bytes of address, family, length."""
    n = 4 if raw[14] == 4 else 14
    address = ipaddress.IPv4Address(raw[:4]) if n == 4 else ipaddress.IPv6Address(raw[:14] + b"\0\0")
    return f"{address}/{raw[15]}"


def prefix_bytes(text: str) -> bytes:
    net = ipaddress.ip_network(text, strict=False)
    packed = net.network_address.packed
    if net.version == 6 and packed[14:] != b"\0\0":
        raise ValueError(f"{text}: more than 14 bytes of address")
    return packed[:14].ljust(14, b"\0") + bytes([net.version, net.prefixlen])


def decode(layout: str, raw: np.ndarray, first: int) -> pa.RecordBatch:
    """Records, and the place of the first of them, as a batch of the layout's columns."""
    long = lambda c: pa.array(raw[c].astype(np.int64))
    if layout in PLACES:
        place = pa.array(np.arange(first, first + len(raw)))
        return pa.RecordBatch.from_arrays([place, *(long(c) for c in raw.dtype.names)], names=[PLACES[layout], *raw.dtype.names])
    if layout == "profile_triplets":
        return pa.RecordBatch.from_arrays([long("profile_id"), long("as_id"), pa.array(raw["hop"].astype(np.int16)), pa.array(raw["weight"])], names=list(raw.dtype.names))
    known: dict[bytes, str] = {}
    prefix = pa.array([known.get(b) or known.setdefault(b, prefix_text(b)) for b in (r.tobytes() for r in raw["prefix"])], pa.string())
    if layout == "prefix_profile_map":
        return pa.RecordBatch.from_arrays([prefix, long("profile_id")], names=["prefix", "profile_id"])
    n = np.minimum(raw["n_links"], PAIRS).astype(np.int64)
    pairs = raw["links"][np.arange(PAIRS)[None, :] < n[:, None]].astype(np.int64)
    links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["from_as", "to_as"]))
    small = lambda c: pa.array(raw[c].astype(np.int32))
    columns = [prefix, long("ts"), long("origin_asn"), long("peer_asn"), small("signal"), small("community"), pa.array(np.where(raw["event"] == 1, "W", "A")), links]
    return pa.RecordBatch.from_arrays(columns, names=["prefix", "ts", "origin_asn", "peer_asn", "signal", "community", "event", "links"])


def encode(layout: str, batch: pa.RecordBatch) -> bytes:
    """The records of a batch with the layout's columns (positional ones in the order of their rows)."""
    if layout == "compact_paths":
        out = []
        for k, path in zip(batch.column("prefix_id").to_pylist(), batch.column("path").to_pylist(), strict=True):
            if len(path) > 255:
                raise ValueError(f"prefix {k}: a path of {len(path)} networks; 255 at most")
            out.append(np.array([(k, len(path))], DTYPES[layout]).tobytes() + np.array(path, "<u4").tobytes())
        return b"".join(out)
    raw = np.zeros(batch.num_rows, DTYPES[layout])
    for c in raw.dtype.names:
        if c == "prefix":
            raw[c] = np.frombuffer(b"".join(prefix_bytes(t) for t in batch.column(c).to_pylist()), np.uint8).reshape(-1, 16)
        elif c == "links":
            for i, links in enumerate(batch.column(c).to_pylist()):
                if len(links) > PAIRS:
                    raise ValueError(f"record {i} has {len(links)} links; {PAIRS} at most")
                raw["n_links"][i] = len(links)
                raw[c][i, : len(links)] = [(x["from_as"], x["to_as"]) for x in links] or 0
        elif c == "event":
            raw[c] = [int(x == "W") for x in batch.column(c).to_pylist()]
        elif c not in ("padding", "n_links"):
            values, kind = batch.column(c).to_numpy(zero_copy_only=False), raw.dtype[c]
            if kind.kind in "iu" and len(values) and not (np.iinfo(kind).min <= values.min() and values.max() <= np.iinfo(kind).max):
                raise ValueError(f"column {c} has values beyond {kind}")
            raw[c] = values
    return raw.tobytes()


@dataclass
class Split(InputPartition):
    path: str
    size: int
    first: int  # record of the file
    count: int
    place: int  # of the file's first record over all files


def open_store(url: str):
    return arrow_fs.FileSystem.from_uri(url) if "://" in url or url.startswith("file:") else (arrow_fs.LocalFileSystem(), url)


class FixedReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.layout, self.split = options["path"], options["layout"], int(options.get("split", str(WIDEST)))
        self.head = COUNT if self.layout in COUNTED else 0
        self.kind = np.dtype(DTYPES[self.layout])

    def partitions(self) -> list[Split]:
        store, at = open_store(self.url)
        info = store.get_file_info(at)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.url)
        files = [info] if info.is_file else [f for f in store.get_file_info(arrow_fs.FileSelector(at, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
        width = max(self.split, min(WIDEST, -(-sum(f.size for f in files) // MOST_SPLITS)))
        out, place, each = [], 0, max(1, width // self.kind.itemsize)
        for f in sorted(files, key=lambda f: f.path):
            if f.size < self.head:
                raise ValueError(f"{f.path}: no count, {f.size} bytes")
            if self.layout == "compact_paths":
                out.append(Split(f.path, f.size, 0, -1, 0))
                continue
            n, rest = divmod(f.size - self.head, self.kind.itemsize)
            if rest:
                raise ValueError(f"{f.path}: truncated, {f.size} bytes are no whole number of records of {self.kind.itemsize}")
            out += [Split(f.path, f.size, k, min(each, n - k), place) for k in range(0, n, each)] or [Split(f.path, f.size, 0, 0, place)]
            place += n
        return out or [Split("", 0, 0, 0, 0)]

    def read(self, p: Split) -> Iterator[pa.RecordBatch]:
        if not p.path:
            return
        store, _ = open_store(self.url)
        with store.open_input_file(p.path) as f:
            if self.head and p.first == 0:
                count = int.from_bytes(f.read_at(COUNT, 0), "little")
                if p.count >= 0 and count * self.kind.itemsize + COUNT != p.size:
                    raise ValueError(f"{p.path}: expected {count * self.kind.itemsize + COUNT} bytes for {count} records, found {p.size}")
            if self.layout == "compact_paths":
                yield from self._paths(f, p, count)
                return
            per = max(1, BLOCK // self.kind.itemsize)
            for k in range(p.first, p.first + p.count, per):
                n = min(per, p.first + p.count - k)
                data = f.read_at(n * self.kind.itemsize, self.head + k * self.kind.itemsize)
                if len(data) != n * self.kind.itemsize:
                    raise ValueError(f"{p.path}: truncated at record {k + len(data) // self.kind.itemsize}")
                yield decode(self.layout, np.frombuffer(data, self.kind), p.place + k)

    def _paths(self, f, p: Split, count: int) -> Iterator[pa.RecordBatch]:
        data, at, read, done = b"", 0, COUNT, 0
        while done < count:
            ids, paths = [], []
            while done < count and len(ids) < 8192:
                if len(data) - at < 5 + 4 * 255 and read < p.size:  # a whole record is there, or the file's end
                    data, at = data[at:] + (more := f.read_at(min(BLOCK, p.size - read), read)), 0
                    read += len(more)
                n = data[at + 4] if len(data) - at >= 5 else 0
                if len(data) - at < 5 + 4 * n:
                    raise ValueError(f"{p.path}: truncated at record {done} of {count}")
                ids.append(int.from_bytes(data[at : at + 4], "little", signed=True))
                paths.append(np.frombuffer(data, "<u4", n, at + 5).astype(np.int64))
                at, done = at + 5 + 4 * n, done + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.list_(pa.int64()))], names=["prefix_id", "path"])
        if read - (len(data) - at) != p.size:
            raise ValueError(f"{p.path}: {p.size - read + len(data) - at} bytes after the last of {count} records")


@dataclass
class Written(WriterCommitMessage):
    unfinished: str
    partition: int
    records: int


class FixedWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.url, self.layout, self.job, self.overwrite = options["path"], options["layout"], uuid.uuid4().hex, overwrite
        store, at = open_store(self.url)
        if not overwrite and store.get_file_info(at).type != arrow_fs.FileType.NotFound and store.get_file_info(arrow_fs.FileSelector(at)):
            raise FileExistsError(self.url)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, at = open_store(self.url)
        store.create_dir(at, recursive=True)
        path, n = f"{at}/.{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}", 0
        body = f"{path}.body"
        with store.open_output_stream(body) as f:  # the count is known at the end
            for b in batches:
                f.write(encode(self.layout, b))
                n += b.num_rows
        with store.open_output_stream(path) as f, store.open_input_stream(body) as g:
            if self.layout in COUNTED:
                f.write(n.to_bytes(COUNT, "little"))
            while data := g.read(BLOCK):
                f.write(data)
        store.delete_file(body)
        return Written(path, task.partitionId(), n)

    def commit(self, messages) -> None:
        store, at = open_store(self.url)
        old = [f.path for f in store.get_file_info(arrow_fs.FileSelector(at)) if f.is_file and not f.base_name.startswith(".")] if self.overwrite and store.get_file_info(at).type != arrow_fs.FileType.NotFound else []
        made = []
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            store.move(m.unfinished, to := f"{at}/part-{m.partition:06d}-{self.job}.bin")
            made.append(to)
        for path in old:
            store.delete_file(path)
        with store.open_output_stream(f"{at}/_SUCCESS"):
            pass
        self._clear(store, at)

    def abort(self, messages) -> None:
        store, at = open_store(self.url)
        if store.get_file_info(at).type != arrow_fs.FileType.NotFound:
            self._clear(store, at)

    def _clear(self, store, at: str) -> None:
        for f in store.get_file_info(arrow_fs.FileSelector(at)):
            if f.base_name.startswith(f".{self.job}"):
                store.delete_file(f.path)


class FixedWidth(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixed_width"

    def schema(self) -> str:
        return SHAPES[self.options["layout"]]

    def reader(self, schema) -> FixedReader:
        return FixedReader(self.options)

    def writer(self, schema, overwrite: bool) -> FixedWriter:
        return FixedWriter(self.options, overwrite)


def read_binary(spark: SparkSession, path: str, layout: str, split: int = WIDEST) -> DataFrame:
    spark.dataSource.register(FixedWidth)
    return spark.read.format("fixed_width").option("layout", layout).option("split", str(split)).load(path)


def write_binary(rows: DataFrame, path: str, layout: str, overwrite: bool = False) -> None:
    """Columns of the layout, a file for each partition; positional layouts want their rows in order (``orderBy``)."""
    rows.sparkSession.dataSource.register(FixedWidth)
    names = [c.split(" ")[0] for c in SHAPES[layout].replace("array<struct<from_as:long,to_as:long>>", "x").split(", ")]
    rows.select(*names).write.format("fixed_width").option("layout", layout).mode("overwrite" if overwrite else "append").save(path)
