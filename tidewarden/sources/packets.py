"""Decoded packet headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.records import HISTORY_LETTERS, or_default, protocol_name, tcp_flags

TCP, UDP = 6, 17


def packet_rows(headers: DataFrame) -> DataFrame:
    """Headers (ts, ip_version, src_ip, dst_ip, ip_proto, src_port, dst_port, tcp_flags, packet_size) to packets.

    Packets without an IP layer are dropped; only TCP and UDP have ports; only TCP has flags.
    """
    keep = [c for c in ("record_id",) if c in headers.columns]
    has_ports = F.col("ip_proto").isin(TCP, UDP)
    return headers.filter("ip_version is not null").select(
        *keep, "ts", "src_ip", "dst_ip",
        F.when(has_ports, or_default("src_port", 0)).otherwise(0).alias("src_port"),
        F.when(has_ports, or_default("dst_port", 0)).otherwise(0).alias("dst_port"),
        protocol_name("ip_proto").alias("protocol"),
        F.col("packet_size").cast("long").alias("packet_size"),
        tcp_flags("tcp_flags", F.col("ip_proto") == TCP).alias("flags"),
    )


def normalise_packets(packets: DataFrame) -> DataFrame:
    """Packets to flow records: each is one originator packet; set flags become history letters."""
    keep = [c for c in ("record_id",) if c in packets.columns]
    letters = [
        F.when(F.try_element_at("flags", F.lit(name)), letter).otherwise("") for name, letter in HISTORY_LETTERS.items()
    ]
    zero = F.lit(0).cast("long")
    return packets.select(
        *keep, "ts", F.lit("").alias("uid"), "src_ip", "src_port", "dst_ip", "dst_port",
        F.lower("protocol").alias("protocol"), F.lit("-").alias("service"), F.lit(0.0).alias("duration"),
        F.col("packet_size").alias("orig_bytes"), zero.alias("resp_bytes"), F.lit("-").alias("conn_state"),
        F.lit(False).alias("local_orig"), F.lit(False).alias("local_resp"), zero.alias("missed_bytes"),
        F.concat(*letters).alias("history"), F.lit(1).cast("long").alias("orig_pkts"),
        F.col("packet_size").alias("orig_ip_bytes"), zero.alias("resp_pkts"), zero.alias("resp_ip_bytes"),
    )
