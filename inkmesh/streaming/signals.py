"""Signals of streaming runs: started, progress, finished and failed, as rows of a table (S3)."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SIGNAL = "at timestamp, run string, name string, signal string, batch long, rows long, message string"


class Signals(StreamingQueryListener):
    """Writes each event of the session's streaming queries to a folder, one small file each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.names: dict[str, str | None] = {}

    def _tell(self, run, signal: str, batch: int | None = None, rows: int | None = None, message: str | None = None) -> None:
        run = str(run)
        row = {"at": dt.datetime.now(dt.timezone.utc).isoformat(), "run": run, "name": self.names.get(run), "signal": signal, "batch": batch, "rows": rows, "message": message}
        jvm, target = self.spark.sparkContext._jvm, f"{self.path}/{uuid.uuid4().hex}.json"
        p = jvm.org.apache.hadoop.fs.Path(target)
        out = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(p, False)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name
        self._tell(event.runId, "started")

    def onQueryProgress(self, event) -> None:
        self._tell(event.progress.runId, "progress", event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._tell(event.runId, "failed" if event.exception else "finished", message=event.exception)
        self.names.pop(str(event.runId), None)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIGNAL).json(path)
