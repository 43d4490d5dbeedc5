"""What the operators of this subpackage share: shared storage and input normalisation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only in local mode (tests, single machines) is one set where the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="pathloom-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Tables that were made in each ``temporary`` block now open.
_MADE: list[list[str]] = []


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there and lost executors cost nothing.

    The innermost ``temporary`` block deletes it at its end; with ``keep``, the one around that does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pathloom/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if len(_MADE) > keep:
        _MADE[-1 - keep].append(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` makes inside are deleted at the end, but for those it is told to keep.

    Garbage is collected too: the driver lets go of the shuffle files and broadcasts of the jobs inside, and of the memory that
    planning them took, before the next ones begin.
    """
    _MADE.append([])
    try:
        yield
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path
        for made in _MADE.pop():
            at = path(made)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        release()
        spark._jvm.System.gc()


def fresh(docs: DataFrame, stem: str) -> str:
    """A column name that ``docs`` doesn't have (names differ by more than case)."""
    known = {c.lower() for c in docs.columns}
    name = stem
    while name.lower() in known:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


def in_share(key: str | Column, fraction: float | Column) -> Column:
    """Whether a row is in a hash share of the keys. Samples are cut to about their size by it before any ordering, so that
    neither a task nor the driver gets a number of rows for each partition."""
    h = F.xxhash64(F.col(key) if isinstance(key, str) else key, F.lit("share"))
    share = F.lit(fraction) if isinstance(fraction, float) else fraction
    return F.pmod(h, F.lit(1 << 40)) < share * F.lit(float(1 << 40))


def text_or_empty(text: str | Column = "text") -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string"), F.lit(""))


#: Texts may be long: what a Python worker gets at once has so many rows and bytes at most (Spark's own defaults are larger).
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def arrow(rows: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with small batches: lowers the session's limits where they are higher."""
    spark = rows.sparkSession
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    return rows.mapInArrow(run, schema)


def release() -> None:
    """Give a Python process's free memory back to the system: a worker stays for other stages, the driver for other jobs."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
