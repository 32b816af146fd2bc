"""Tab-separated connection logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.functions.records import or_zero_dash
from tidewarden.schemas import CONN_COLUMNS, FLOW_SCHEMA

BLANKS = " \t\n\r\x0b\x0c"
# Numbers in which a dash stands for 0.
DASH_COLUMNS = {
    "duration", "orig_bytes", "resp_bytes", "missed_bytes", "orig_pkts", "orig_ip_bytes", "resp_pkts",
    "resp_ip_bytes",
}


def _field(name: str) -> Column:
    return F.get("_fields", F.lit(CONN_COLUMNS.index(name)))


def _value(name: str, kind: str) -> Column:
    if name == "ts":
        seconds = _field("timestamp").try_cast("double")
        return F.timestamp_micros(F.round(seconds * 1e6).try_cast("bigint"))
    text = _field(name)
    if kind == "boolean":
        return text == "T"
    if name in DASH_COLUMNS:
        return or_zero_dash(text, kind)
    return text if kind == "string" else text.try_cast(kind)


def parse_conn_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Log lines to flow records plus ``reject_reason``, NULL for good rows. Header lines are dropped.

    A bad row is rejected on its own; the rows after it stay.
    """
    other = [c for c in lines.columns if c != value]
    # A one-element explode keeps later filters above the split, which would otherwise run once per field.
    fields = F.explode(F.array(F.split(F.trim(F.col(value), F.lit(BLANKS)), "\t")))
    text = lines.filter(~F.startswith(value, F.lit("#"))).select("*", fields.alias("_fields"))
    parsed = text.select(
        *other, value, F.size("_fields").alias("_size"),
        *[_value(f.name, f.dataType.simpleString()).alias(f.name) for f in FLOW_SCHEMA.fields],
    )
    numbers = [f.name for f in FLOW_SCHEMA.fields if f.dataType.simpleString() not in ("string", "boolean")]
    unreadable = F.lit(False)
    for name in numbers:
        unreadable = unreadable | F.col(name).isNull()
    reason = F.when(F.col("_size") < len(CONN_COLUMNS), "short line").when(unreadable, "bad number")
    return parsed.withColumn("reject_reason", reason).drop("_size")


def good_rows(parsed: DataFrame, value: str = "value") -> DataFrame:
    return parsed.filter("reject_reason is null").drop("reject_reason", value)


def rejected_rows(parsed: DataFrame, value: str = "value") -> DataFrame:
    return parsed.filter("reject_reason is not null").select(
        *[c for c in parsed.columns if c not in FLOW_SCHEMA.names]
    ).withColumnRenamed(value, "line")


def read_conn_log(spark: SparkSession, path: str) -> DataFrame:
    return good_rows(parse_conn_lines(spark.read.text(path)))


def read_conn_rejects(spark: SparkSession, path: str) -> DataFrame:
    return rejected_rows(parse_conn_lines(spark.read.text(path)))


def conn_lines(records: DataFrame) -> DataFrame:
    """Flow records back to log lines."""
    def text(name: str) -> Column:
        if name == "timestamp":
            return F.format_string("%d.%06d", F.floor(F.unix_micros("ts") / 1_000_000), F.unix_micros("ts") % 1_000_000)
        if name in ("local_orig", "local_resp"):
            return F.when(F.col(name), "T").otherwise("F")
        return F.col(name).cast("string")

    return records.select("record_id", F.concat_ws("\t", *[text(n) for n in CONN_COLUMNS]).alias("value"))
