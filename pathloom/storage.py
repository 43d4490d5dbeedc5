"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables of the innermost ``working`` block of this thread (or task), if one is open.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only in local mode (tests, single machines) is one set where the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="pathloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written there and read again: what several jobs use is computed once, and lost executors cost nothing. A ``working``
    block deletes it at its end; outside of one it stays, as the result may be read at any time."""
    schema, path = df.schema, f"{shared_dir(df.sparkSession)}/pathloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(schema).parquet(path)


@contextmanager
def working(spark: SparkSession) -> Iterator[None]:
    """For work whose results are written before the block ends: tables that ``stored`` makes inside are deleted then, also on
    failure. Blocks nest, and those of other threads have their own lists."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for at in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
