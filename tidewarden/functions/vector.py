"""The fixed-order numeric vector a model reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The order of the 36 vector entries.
FLOW_ENTRIES = [
    "duration", "packet_count", "byte_count", "packets_per_second", "bytes_per_second", "avg_packet_size",
    "std_packet_size", "min_packet_size", "max_packet_size", "time_of_day", "day_of_week", "entropy",
    "unique_dst_ports", "unique_dst_ips", "recent_flows", "recent_bytes", "recent_packets",
]
FLAG_ENTRIES = ["SYN", "ACK", "FIN", "RST", "PSH", "URG"]
HTTP_ENTRIES = ["request_count", "response_count", "avg_uri_length", "unique_user_agents"]
METHOD_ENTRIES = ["GET", "POST", "PUT", "DELETE"]
DNS_ENTRIES = ["query_count", "response_count", "nxdomain_ratio", "avg_domain_length", "unique_domains"]

ENTRY_NAMES = (
    FLOW_ENTRIES + FLAG_ENTRIES + [f"http_{n}" for n in HTTP_ENTRIES]
    + [f"http_methods_{n}" for n in METHOD_ENTRIES] + [f"dns_{n}" for n in DNS_ENTRIES]
)


def numeric_or_zero(df: DataFrame, name: str) -> Column:
    """A flow entry: missing, textual or unreadable values count as 0."""
    if name not in df.columns or df.schema[name].dataType.simpleString() in ("string", "binary"):
        return F.lit(0.0).cast("float")
    return F.coalesce(F.col(name).try_cast("float"), F.lit(0.0).cast("float"))


def _nested(df: DataFrame) -> list[Column]:
    have = set(df.columns)
    missing = F.lit(None).cast("float")
    flags = [F.try_element_at("tcp_flags", F.lit(n)) if "tcp_flags" in have else missing for n in FLAG_ENTRIES]
    http = [F.col(f"http_features.{n}") if "http_features" in have else missing for n in HTTP_ENTRIES]
    methods = [
        F.try_element_at(F.col("http_features.methods"), F.lit(n)) if "http_features" in have else missing
        for n in METHOD_ENTRIES
    ]
    dns = [F.col(f"dns_features.{n}") if "dns_features" in have else missing for n in DNS_ENTRIES]
    return flags + http + methods + dns


def feature_vector(df: DataFrame, name: str = "vector") -> DataFrame:
    """Add the 36-long float vector. One unreadable nested value makes the whole vector zero."""
    nested = _nested(df)
    zero = F.lit(0.0).cast("float")
    entries = [numeric_or_zero(df, n) for n in FLOW_ENTRIES] + [F.coalesce(c.try_cast("float"), zero) for c in nested]
    unreadable = F.lit(False)
    for c in nested:
        unreadable = unreadable | (c.isNotNull() & c.try_cast("float").isNull())
    return df.withColumn(name, F.when(unreadable, F.array_repeat(zero, len(entries))).otherwise(F.array(*entries)))
