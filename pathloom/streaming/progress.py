"""Figures of streaming queries as a table: one small file for each micro-batch, written whole by a listener."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..sources import commits

SHAPE = "query string, run string, batch long, at timestamp, input_rows long, rows_per_second double, state_rows long, millis map<string,long>"


class ProgressTable(StreamingQueryListener):
    """Add it with ``spark.streams.addListener``; a batch that is reported twice is written once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        said = {
            "query": str(p.id), "run": str(p.runId), "batch": p.batchId, "at": p.timestamp, "input_rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond,
            "state_rows": sum(s.numRowsTotal for s in p.stateOperators), "millis": {k: int(v) for k, v in dict(p.durationMs).items()},
        }
        if p.numInputRows or said["millis"].get("addBatch") is not None:  # not the idle reports
            commits.write_text(self.spark, f"{self.path}/{p.runId}-{p.batchId:012d}.json", json.dumps(said))

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def table(self) -> DataFrame:
        return self.spark.read.schema(SHAPE).json(self.path) if commits.names(self.spark, self.path) else self.spark.createDataFrame([], SHAPE)
