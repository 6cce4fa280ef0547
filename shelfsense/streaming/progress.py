"""Progress of streaming queries as a table that outlives them.

Spark keeps the reports of a query's last batches in memory. The log writes every report to a file
of its own under a shared folder, named by query and batch, so a restarted query goes on where it
was, and a batch that is repeated replaces its report.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.readers import _file_system, path_exists

REPORT = "query string, run string, name string, batch bigint, at string, rows bigint, seconds double, state_rows bigint, metrics map<string,string>"


class ProgressLog(StreamingQueryListener):
    """Add it to ``spark.streams`` for the queries to be logged; ``names`` limits it to some."""

    def __init__(self, spark: SparkSession, folder: str, names: tuple[str, ...] = ()):
        self.spark, self.folder, self.names = spark, folder, names

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        if self.names and progress.name not in self.names:
            return
        metrics = {
            f"{name}.{field}": str(value)
            for name, row in progress.observedMetrics.items()
            for field, value in row.asDict().items()
        }
        report = {
            "query": str(progress.id), "run": str(progress.runId), "name": progress.name,
            "batch": progress.batchId, "at": progress.timestamp, "rows": progress.numInputRows,
            "seconds": progress.batchDuration / 1000,
            "state_rows": sum(s.numRowsTotal for s in progress.stateOperators), "metrics": metrics,
        }
        self._write(f"{self.folder}/{progress.id}-{progress.batchId:012d}.json", json.dumps(report) + "\n")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def _write(self, path: str, text: str) -> None:
        """Under another name first, so that readers only see whole reports."""
        files, where = _file_system(self.spark, path)
        part = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_{where.getName()}")
        out = files.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        files.delete(where, False)
        files.rename(part, where)


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    """One row per reported batch, in no order; a missing folder is an empty table."""
    if not path_exists(spark, folder):
        return spark.createDataFrame([], REPORT)
    return spark.read.schema(REPORT).json(folder)
