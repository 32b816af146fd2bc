"""Live statistics: a stage counts its rows while it runs, and a listener writes the counts of every micro-batch.

The counts are part of the job that does the work, so totals, errors and rates cost no second pass over what a stage
wrote. A retried micro-batch is counted once: rows are kept by run and batch.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidewarden.operators.monitoring import SECOND, with_rate

COUNTS_SCHEMA = "stage string, run_id string, batch long, processed long, errors long, first_at long, last_at long"
PREFIX = "stage:"


def counts_of(at: str | Column, bad: Column | None = None) -> list[Column]:
    """What a stage counts: rows done, rows rejected, and the span of event time (microseconds) of the former."""
    wrong = F.lit(False) if bad is None else F.coalesce(bad, F.lit(False))
    moment = F.when(~wrong, F.col(at) if isinstance(at, str) else at)
    return [
        F.count_if(~wrong).alias("processed"), F.count_if(wrong).alias("errors"), F.min(moment).alias("first_at"), F.max(moment).alias("last_at"),
    ]


def observed(rows: DataFrame, stage: str, at: str | Column, bad: Column | None = None) -> DataFrame:
    """The same rows of a stream, counted under the stage's name as they pass."""
    return rows.observe(PREFIX + stage, *counts_of(at, bad))


def observed_batch(rows: DataFrame, at: str | Column, bad: Column | None = None) -> tuple[DataFrame, Observation]:
    """The same rows of a batch; the observation has the counts once they have been written somewhere."""
    counts = Observation()
    return rows.observe(counts, *counts_of(at, bad)), counts


class StatisticsWriter(StreamingQueryListener):
    """Appends the counts of every micro-batch, one small row for each stage, to the table in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def _end_of(self, run_id: str) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(run_id, threading.Event())

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        rows = [
            (name.removeprefix(PREFIX), str(progress.runId), progress.batchId, counts["processed"], counts["errors"], counts["first_at"], counts["last_at"])
            for name, counts in progress.observedMetrics.items() if name.startswith(PREFIX)
        ]
        if rows:
            self.spark.createDataFrame(rows, COUNTS_SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._end_of(str(event.runId)).set()

    def wait_for(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until all that an ended query counted has been written."""
        query.awaitTermination()
        if not self._end_of(str(query.runId)).wait(seconds):
            raise TimeoutError(f"the end of {query.runId} was not reported within {seconds} s")


def live_statistics(spark: SparkSession, folder: str, now: int) -> DataFrame:
    """Totals, errors, uptime and rate of each stage from the counts written so far; uptime runs from its first row."""
    batches = spark.read.schema(COUNTS_SCHEMA).parquet(folder).dropDuplicates(["stage", "run_id", "batch"])
    totals = batches.groupBy("stage").agg(
        F.sum("processed").alias("processed"), F.sum("errors").alias("errors"),
        F.coalesce((F.lit(now) - F.min("first_at")) / F.lit(float(SECOND)), F.lit(0.0)).alias("uptime_seconds"))
    return with_rate(totals)
