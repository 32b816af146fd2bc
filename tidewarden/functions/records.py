"""Column helpers for flow records, packets and log text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bit of each TCP flag in the header byte.
TCP_FLAG_BITS = {"SYN": 0x02, "ACK": 0x10, "FIN": 0x01, "RST": 0x04, "PSH": 0x08, "URG": 0x20}
# The letter that stands for each flag in a connection's history.
HISTORY_LETTERS = {"SYN": "S", "ACK": "A", "FIN": "F", "RST": "R", "PSH": "P", "URG": "U"}
# IP protocol numbers with a name.
PROTOCOL_NAMES = {6: "TCP", 17: "UDP", 1: "ICMP"}


def or_default(column: str | Column, default) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(default))


def flow_key() -> Column:
    """``src_ip:src_port-dst_ip:dst_port``; the protocol is not part of it."""
    return F.concat(
        or_default("src_ip", ""), F.lit(":"), or_default("src_port", 0).cast("string"), F.lit("-"),
        or_default("dst_ip", ""), F.lit(":"), or_default("dst_port", 0).cast("string"),
    )


def micros(ts: str | Column = "ts") -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def total_bytes() -> Column:
    return or_default("orig_bytes", 0) + or_default("resp_bytes", 0)


def total_packets() -> Column:
    return or_default("orig_pkts", 0) + or_default("resp_pkts", 0)


def letters(text: str | Column, letter: str) -> Column:
    """How often one letter occurs; case matters."""
    text = F.col(text) if isinstance(text, str) else text
    return (F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))).cast("long")


def or_zero_dash(text: Column, kind: str) -> Column:
    """A log number: ``-`` is 0, anything unreadable is NULL."""
    return F.when(text == "-", F.lit(0).cast(kind)).otherwise(text.try_cast(kind))


def tcp_flags(bits: str | Column, is_tcp: Column) -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    pairs = [x for name, bit in TCP_FLAG_BITS.items() for x in (F.lit(name), bits.bitwiseAND(F.lit(bit)) != 0)]
    return F.when(is_tcp, F.create_map(*pairs))


def protocol_name(number: str) -> Column:
    named = F.when(F.lit(False), F.lit(""))
    for code, name in PROTOCOL_NAMES.items():
        named = named.when(F.col(number) == code, name)
    return named.otherwise(F.col(number).cast("string"))


def time_of_day(ts: str | Column) -> Column:
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def day_of_week(ts: str | Column) -> Column:
    """Monday = 0."""
    return F.weekday(ts)


def clamp01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def per_second(total: str, seconds: str) -> Column:
    return F.when(F.col(seconds) > 0, F.col(total) / F.col(seconds)).otherwise(F.lit(0.0))


def count_map(pairs: Column) -> Column:
    """Array of (name, count) structs to a map."""
    return F.map_from_entries(pairs)
