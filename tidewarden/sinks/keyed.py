"""Keyed JSON messages, to a topic or to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY_DEFAULT = "unknown"
# Times keep their microseconds on the way.
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def keyed_json(df: DataFrame, key: str | Column) -> DataFrame:
    """(key, value) with the whole row as JSON; a missing key becomes ``unknown``."""
    key = F.col(key) if isinstance(key, str) else key
    return df.select(F.coalesce(key, F.lit(KEY_DEFAULT)).alias("key"), F.to_json(F.struct("*"), JSON_OPTIONS).alias("value"))


def write_keyed_json(df: DataFrame, key: str | Column, path: str | None = None, **kafka: str) -> None:
    """Batch write to ``path`` as parquet, or to Kafka by its options (``topic``, ``kafka.bootstrap.servers``)."""
    out = keyed_json(df, key)
    if path:
        out.write.mode("append").parquet(path)
    else:
        out.write.format("kafka").options(**kafka).save()


def stream_keyed_json(
    df: DataFrame, key: str | Column, checkpoint: str, path: str | None = None, trigger: dict | None = None, **kafka: str
) -> StreamingQuery:
    """The streaming twin; exactly once to files, at least once to Kafka."""
    writer = keyed_json(df, key).writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"}))
    if path:
        return writer.format("parquet").option("path", path).start()
    return writer.format("kafka").options(**kafka).start()
