"""Streams of JSON records from topics or folders, and growing logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.schemas import EVE_SCHEMA, FEATURE_SCHEMA, FLOW_SCHEMA, METRIC_SCHEMA, RESULT_SCHEMA
from tidewarden.sources.conn_log import good_rows, parse_conn_lines
from tidewarden.sources.eve_log import decode_json, good_json
from tidewarden.sources.log_tail import PIECE, tail_lines

# Topic names.
TOPICS = {
    "network_logs": "network-logs", "features": "features", "decisions": "decisions", "alerts": "alerts",
    "decision_logs": "decision-logs", "metrics": "metrics-events", "aggregated": "aggregated-metrics",
    "system_alerts": "system-alerts",
}


def topic_stream(spark: SparkSession, servers: str, topic: str, starting: str = "latest", **options: str) -> DataFrame:
    """Message values of a Kafka topic as text; needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    reader = reader.option("subscribe", topic).option("startingOffsets", starting)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def folder_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of a growing folder; the checkpoint reads each file once."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def records_of(lines: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Decoded records of a stream or batch; undecodable messages are left to ``rejects_of``."""
    return good_json(decode_json(lines, schema, value), value)


def rejects_of(lines: DataFrame, schema: T.StructType, required: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Messages that are not JSON or lack a required field, with the reason."""
    decoded = decode_json(lines, schema, value)
    reason = F.col("reject_reason")
    for name in required:
        reason = F.coalesce(reason, F.when(F.col(name).isNull(), f"no {name}"))
    return decoded.withColumn("reject_reason", reason).filter("reject_reason is not null").select(
        F.col(value).alias("line"), "reject_reason"
    )


def with_id(schema: T.StructType, name: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.LongType()), *schema.fields])


def stream_flows(lines: DataFrame) -> DataFrame:
    return records_of(lines, with_id(FLOW_SCHEMA, "record_id"))


def stream_features(lines: DataFrame) -> DataFrame:
    return records_of(lines, with_id(FEATURE_SCHEMA, "window_id"))


def stream_results(lines: DataFrame) -> DataFrame:
    return records_of(lines, with_id(RESULT_SCHEMA, "result_id"))


def stream_metric_events(lines: DataFrame) -> DataFrame:
    return records_of(lines, with_id(METRIC_SCHEMA, "id"))


def tail_conn_log(spark: SparkSession, path: str, late: str | None = "10 minutes", pattern: str = "[!._]*", piece: int = PIECE) -> DataFrame:
    """Connection rows as lines are added to the logs of a folder.

    Every line is read once. With ``late``, a ``uid`` that the sensor writes again within that delay is left out.
    """
    rows = good_rows(parse_conn_lines(tail_lines(spark, path, pattern, piece).select("value")))
    return rows if late is None else rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["uid"])


def tail_event_log(spark: SparkSession, path: str, pattern: str = "[!._]*", piece: int = PIECE) -> DataFrame:
    """Sensor events as lines are added to the logs of a folder, with the line in ``raw``."""
    lines = tail_lines(spark, path, pattern, piece).select(F.col("value").alias("raw"), "value")
    return good_json(decode_json(lines, EVE_SCHEMA))
