"""Sensor events: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.functions.records import or_default
from tidewarden.schemas import EVE_SCHEMA
from tidewarden.sinks.keyed import KEY_DEFAULT

# One to six digits of a second, or none; the offset with or without a colon, or Z.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][xxx][xx][X]"


def decode_json(lines: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Decode one JSON column into the schema's columns; ``reject_reason`` is NULL for good rows."""
    with_corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    other = [c for c in lines.columns if c != value]
    # Exploded from an array of one, so that filters stay above and no line is decoded again for them.
    decoded = lines.withColumn("_j", F.explode(F.array(F.from_json(F.trim(value), with_corrupt, options))))
    bad = F.col("_j").isNull() | F.col("_j._corrupt").isNotNull()
    return decoded.select(
        *other, value, F.when(bad, "not JSON").alias("reject_reason"), *[F.col(f"_j.{n}").alias(n) for n in schema.names]
    )


def good_json(decoded: DataFrame, value: str = "value") -> DataFrame:
    return decoded.filter("reject_reason is null").drop("reject_reason", value)


def rejected_json(decoded: DataFrame, value: str = "value") -> DataFrame:
    return decoded.filter("reject_reason is not null").select(F.col(value).alias("line"), "reject_reason")


def read_eve_log(spark: SparkSession, path: str) -> DataFrame:
    """All decodable events, with the raw line kept in ``raw``."""
    lines = spark.read.text(path).withColumn("raw", F.col("value"))
    return good_json(decode_json(lines, EVE_SCHEMA))


def event_messages(events: DataFrame) -> DataFrame:
    """Raw events as keyed messages; an event without a source goes to ``unknown``."""
    return events.select(F.coalesce("src_ip", F.lit(KEY_DEFAULT)).alias("key"), F.col("raw").alias("value"))


def normalise_eve(events: DataFrame, keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """Sensor events to flow records: names, text times and sizes mapped, unknown fields at their defaults.

    Columns named in ``keep`` come along, if there.
    """
    keep = [c for c in keep if c in events.columns]
    count = lambda name: or_default(f"flow.{name}", 0)
    return events.select(
        *keep,
        F.try_to_timestamp("timestamp", F.lit(TIME_FORMAT)).alias("ts"),
        F.concat(F.lit("E"), F.col("flow_id").cast("string")).alias("uid"),
        or_default("src_ip", "").alias("src_ip"), or_default("src_port", 0).alias("src_port"),
        or_default("dest_ip", "").alias("dst_ip"), or_default("dest_port", 0).alias("dst_port"),
        F.lower(or_default("proto", "")).alias("protocol"), or_default("event_type", "-").alias("service"),
        F.lit(0.0).alias("duration"),
        count("bytes_toserver").alias("orig_bytes"), count("bytes_toclient").alias("resp_bytes"),
        F.lit("-").alias("conn_state"), F.lit(False).alias("local_orig"), F.lit(False).alias("local_resp"),
        F.lit(0).cast("long").alias("missed_bytes"), F.lit("-").alias("history"),
        count("pkts_toserver").alias("orig_pkts"), count("bytes_toserver").alias("orig_ip_bytes"),
        count("pkts_toclient").alias("resp_pkts"), count("bytes_toclient").alias("resp_ip_bytes"),
    )
