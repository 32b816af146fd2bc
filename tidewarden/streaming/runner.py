"""Running a stream to a table: what is there now, or continuously."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidewarden.session import run_dir

# Poll period of the record streams and emission period of the aggregated metrics.
RECORD_TRIGGER = {"processingTime": "1 second"}
METRIC_TRIGGER = {"processingTime": "30 seconds"}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# State stores of a stream with few keys, at most, for each core.
STORES_PER_CORE = 4


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state lives in RocksDB, so it may exceed a task's memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


@contextmanager
def few_stores(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in a number of stores that the cores can visit in a few rounds.

    Every micro-batch runs a task for each store, also for one without a key, so with few keys the usual number of shuffle
    partitions is most of its time. The number is kept in the checkpoint.
    """
    name = "spark.sql.shuffle.partitions"
    held = spark.conf.get(name)
    spark.conf.set(name, min(int(held), STORES_PER_CORE * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, held)


def start(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, mode: str = "append") -> StreamingQuery:
    """Append the stream's rows to a parquet table, exactly once across restarts from the checkpoint."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode(mode).trigger(**(trigger or RECORD_TRIGGER)).start()


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run everything available now and return the table written."""
    spark = df.sparkSession
    path = run_dir(spark, "stream")
    start(df, path, run_dir(spark, "checkpoint"), {"availableNow": True}, mode).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def per_batch(
    df: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: dict | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """Apply a batch operator to every micro-batch. Each batch owns a folder, so a retried batch replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
    return writer.trigger(**(trigger or RECORD_TRIGGER)).start()


def drain_per_batch(df: DataFrame, work: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    spark = df.sparkSession
    path = run_dir(spark, "stream")
    per_batch(df, work, path, run_dir(spark, "checkpoint"), {"availableNow": True}, mode).awaitTermination()
    return spark.read.parquet(path).drop("batch")
