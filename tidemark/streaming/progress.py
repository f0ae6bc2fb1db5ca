"""What a stream says of itself: measures of each micro-batch, taken as its rows pass, and runs at an interval."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.storage import file_system

METRICS = "batch long, n long, n_correct long, n_input long"


def measured(rows: DataFrame, correct: Column, name: str = "accuracy") -> DataFrame:
    """``rows``, counted with their correct ones as they pass; no pass of its own."""
    return rows.observe(name, F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(correct, F.lit(False)).cast("long")).alias("n_correct"))


class MetricsLog(StreamingQueryListener):
    """Writes the measures of each micro-batch of the query ``query`` as a file of its own; a batch that runs again overwrites its file.

    A micro-batch without rows has no measures and writes nothing. `read` gives them as rows.
    """

    def __init__(self, spark: SparkSession, folder: str, query: str, name: str = "accuracy"):
        self.spark, self.folder, self.query, self.name = spark, folder, query, name
        self.ended: list[str] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        row = (progress.observedMetrics or {}).get(self.name)
        if progress.name != self.query or row is None or not row["n"]:
            return
        line = json.dumps({"batch": progress.batchId, "n": row["n"], "n_correct": row["n_correct"], "n_input": progress.numInputRows})
        fs, at = file_system(self.spark, f"{self.folder}/batch-{progress.batchId:012d}.json")
        out = fs.create(at, True)
        out.write(bytearray(line.encode()))
        out.close()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.append(str(event.id))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """batch, n, n_correct, n_input of a `MetricsLog`."""
    return spark.read.schema(METRICS).json(folder)


def run(stream: DataFrame, path: str, checkpoint: str, query: str, folder: str, interval: str | None = None, seconds: float | None = None):
    """Write a `measured` stream as Parquet and its measures to ``folder``.

    Until its source is drained; or with an interval, a micro-batch each ``interval`` until ``seconds`` have passed (then what is there is
    finished first) or the query ends. Returns the query, when all its measures are written.
    """
    spark = stream.sparkSession
    log = MetricsLog(spark, folder, query)
    spark.streams.addListener(log)
    try:
        trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
        running = stream.writeStream.queryName(query).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
        if seconds is None:
            running.awaitTermination()
        elif not running.awaitTermination(seconds):
            running.processAllAvailable()
            running.stop()
        # Events arrive in order: once the end is known, so are all measures.
        wait = 0
        while str(running.id) not in log.ended and wait < 600:
            wait += 1
            spark._jvm.Thread.sleep(50)
        return running
    finally:
        spark.streams.removeListener(log)
