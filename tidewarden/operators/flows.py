"""Flow windows and the features of each window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.records import (
    HISTORY_LETTERS, day_of_week, flow_key, letters, micros, or_default, per_second, time_of_day, total_bytes,
    total_packets,
)
from tidewarden.functions.text import text_entropy
from tidewarden.operators.application import dns_features, http_features
from tidewarden.operators.anchored import HOT_ROWS, anchored_windows
from tidewarden.operators.chained import BLOCK_ROWS
from tidewarden.operators.hosts import host_context
from tidewarden.session import materialize
from tidewarden.schemas import DNS_SCHEMA, FEATURE_SCHEMA, HTTP_SCHEMA, TEXT_COLUMNS

SECOND = 1_000_000
# 60 s windows of at most 1000 records; a host's newest 1000 records count as recent.
WINDOW_US = 60 * SECOND
WINDOW_RECORDS = 1000
HOST_HISTORY = 1000
WINDOW_KEY = ["flow_key", "window_at", "window_id"]


def flow_windows(
    records: DataFrame, width: int = WINDOW_US, cap: int | None = WINDOW_RECORDS, hot_rows: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Records with their flow key and the first time and id of their anchored window, in event time."""
    keyed = records.withColumns({"flow_key": flow_key(), "at": micros()})
    return anchored_windows(keyed, ["flow_key"], "at", "record_id", width, cap, hot_rows, block_rows)


def first_of_window(column: str) -> Column:
    return F.min_by(column, F.struct("at", "record_id"))


def size_statistics() -> dict[str, Column]:
    """Bytes per packet of each direction that has packets; population deviation; zeros without any.

    The two directions are pooled from their own moments, so rows need not be doubled.
    """
    ratios = [
        F.when(F.col(pkts) > 0, F.col(size) / F.col(pkts))
        for size, pkts in (("orig_bytes", "orig_pkts"), ("resp_bytes", "resp_pkts"))
    ]
    zero = F.lit(0.0)
    counts = [F.count(r) for r in ratios]
    n = counts[0] + counts[1]
    mean = (F.coalesce(F.sum(ratios[0]), zero) + F.coalesce(F.sum(ratios[1]), zero)) / n
    spread = [
        c * F.coalesce(F.var_pop(r) + (F.avg(r) - mean) * (F.avg(r) - mean), zero) for c, r in zip(counts, ratios)
    ]
    some = lambda value: F.when(n > 0, value).otherwise(zero)
    return {
        "avg_packet_size": some(mean),
        "std_packet_size": some(F.sqrt((spread[0] + spread[1]) / n)),
        "min_packet_size": some(F.least(*[F.min(r) for r in ratios])),
        "max_packet_size": some(F.greatest(*[F.max(r) for r in ratios])),
    }


def flag_counts() -> dict[str, Column]:
    return {name: F.sum(letters("history", letter)) for name, letter in HISTORY_LETTERS.items()}


def flag_map(counts: dict[str, Column] | list[str]) -> Column:
    """Flag counts as a map; empty where no record had a history."""
    names = list(counts)
    filled = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    return F.when(F.col(names[0]).isNotNull(), filled).otherwise(F.create_map().cast("map<string,bigint>"))


def empty_protocol(schema) -> Column:
    """Application-layer statistics of a flow without an application log: all zero."""
    blank = {"map": F.create_map(), "bigint": F.lit(0), "double": F.lit(0.0)}
    return F.struct(*[
        blank[f.dataType.simpleString().split("<")[0]].cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def protocol_or_empty(df: DataFrame, name: str, schema) -> Column:
    if name not in df.columns:
        return empty_protocol(schema)
    shaped = F.struct(*[F.col(f"{name}.{f.name}").cast(f.dataType).alias(f.name) for f in schema.fields])
    return F.when(F.col(name).isNotNull(), shaped).otherwise(empty_protocol(schema))


def window_statistics(windowed: DataFrame, text: bool = True) -> DataFrame:
    """One row per flow window; all statistics in one aggregation on the window key.

    ``text`` gathers the window's text in its row, which the record cap keeps small; for uncapped windows leave
    it out and use ``character_entropy``.
    """
    gathered = {"_text": F.array_join(F.collect_list(F.concat_ws("", *TEXT_COLUMNS)), "")} if text else {}
    aggregates = {
        **{c: first_of_window(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "ts")},
        "record_count": F.count(F.lit(1)),
        "first_at": F.min("at"),
        "last_at": F.max("at"),
        "byte_count": F.sum(total_bytes()),
        "packet_count": F.sum(total_packets()),
        **size_statistics(),
        **flag_counts(),
        **gathered,
    }
    grouped = windowed.groupBy(*WINDOW_KEY).agg(*[c.alias(n) for n, c in aggregates.items()])
    out = grouped.withColumn("duration", (F.col("last_at") - F.col("first_at")) / F.lit(float(SECOND)))
    out = out.withColumns({
        "packets_per_second": per_second("packet_count", "duration"),
        "bytes_per_second": per_second("byte_count", "duration"),
        "time_of_day": time_of_day("ts"),
        "day_of_week": day_of_week("ts"),
    })
    return out.withColumn("entropy", text_entropy(F.col("_text"))).drop("_text") if text else out


def flow_features(
    records: DataFrame, width: int = WINDOW_US, cap: int | None = WINDOW_RECORDS, hot_rows: int = HOT_ROWS,
    max_history: int | None = None, http: DataFrame | None = None, dns: DataFrame | None = None,
) -> DataFrame:
    """The full feature record of every flow window, keyed by the window, with its host's context.

    ``max_history`` (``HOST_HISTORY`` is the customary value) limits what counts as recent; by default nothing does.

    ``http`` and ``dns`` are application logs whose rows name their connection by ``uid``; each counts in the window of
    its connection, and rows of unknown connections are left out. The windows and the window of each connection are
    written once for them, and each log once with its windows, since its statistics read it several times.

    The window statistics are written once: the host context reads them twice, and only four columns of them.
    """
    windowed = flow_windows(records, width, cap, hot_rows)
    logs = {"http_features": (http, http_features), "dns_features": (dns, dns_features)}
    if http is not None or dns is not None:
        windowed = materialize(windowed)
        connections = materialize(connection_windows(windowed))
    stats = materialize(window_statistics(windowed))
    context = host_context(records, stats.filter("src_ip <> ''"), WINDOW_KEY, width, max_history=max_history)
    joined = stats.join(context.drop("src_ip"), WINDOW_KEY, "left")
    for name, (log, statistics) in logs.items():
        if log is not None:
            joined = joined.join(window_application(connections, log, statistics, name), WINDOW_KEY, "left")
    return feature_record(joined)


def connection_windows(windowed: DataFrame) -> DataFrame:
    """The window of each connection (``uid``). A record that was delivered more than once counts as one connection."""
    first = windowed.filter("uid is not null").groupBy("uid").agg(F.min(F.struct(*WINDOW_KEY)).alias("w"))
    return first.select("uid", "w.*")


def window_application(
    connections: DataFrame, log: DataFrame, statistics: Callable[[DataFrame, list[str]], DataFrame], name: str
) -> DataFrame:
    """Application statistics of each flow window that has any, as one struct: log rows meet connections by ``uid``."""
    found = statistics(materialize(log.join(connections, "uid").drop("uid")), WINDOW_KEY)
    return found.select(*WINDOW_KEY, F.struct(*[c for c in found.columns if c not in WINDOW_KEY]).alias(name))


def feature_record(df: DataFrame) -> DataFrame:
    """The 26 published columns in order, after the window key; missing values take their defaults."""
    shaped = df.withColumns({
        "timestamp": F.col("ts"),
        "src_ip": or_default("src_ip", ""),
        "dst_ip": or_default("dst_ip", ""),
        "src_port": or_default("src_port", 0),
        "dst_port": or_default("dst_port", 0),
        "protocol": or_default("protocol", ""),
        "tcp_flags": flag_map(list(HISTORY_LETTERS)),
        **{n: protocol_or_empty(df, n, kind) for n, kind in (("http_features", HTTP_SCHEMA), ("dns_features", DNS_SCHEMA))},
        **{n: or_default(n, 0) for n in ("unique_dst_ips", "unique_dst_ports", "recent_flows", "recent_bytes",
                                         "recent_packets")},
    })
    return shaped.select(*WINDOW_KEY, *[F.col(f.name).cast(f.dataType).alias(f.name) for f in FEATURE_SCHEMA.fields])
